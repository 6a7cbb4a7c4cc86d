"""Queries of the kernels that SQL cannot express, and of reports over files and pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from geoloom.functions import grid, text
from geoloom.operators import masks, raster, workflow
from geoloom.plans import views
from geoloom.plans.dataset_queries import label_samples
from geoloom.plans.registry import query
from geoloom.sources import readers


def _tiles(spark, d):
    return views.polygons(spark, d).select(F.col("stem").alias("tile"), F.lit(64).alias("h"), F.lit(64).alias("w")).distinct()


def _labels(spark, d):
    p = views.polygons(spark, d).withColumn("coords", F.transform("coords", lambda v: F.least(F.lit(1.0), v * 4)))
    return p.withColumn("class_id", F.col("class_id") % 2).withColumn("line_no", F.col("line_no").cast("int"))


def _masks(spark, d):
    return masks.labels_to_masks(_labels(spark, d), _tiles(spark, d), {0: 255, 1: 128})


@query()
def rasterize_polys(spark, d):
    """Pixels of each class in each tile's mask."""

    def run(batches):
        for b in batches:
            v = [np.frombuffer(x, np.uint8) for x in b["data"]]
            yield pd.DataFrame({"tile": b.tile, "n_ridge": [int((x == 255).sum()) for x in v], "n_valley": [int((x == 128).sum()) for x in v]})

    return _masks(spark, d).mapInPandas(run, "tile string, n_ridge long, n_valley long")


@query()
def contour_labels(spark, d):
    return masks.trace(_masks(spark, d), {255: 0, 128: 1})


@query()
def label_roundtrip(spark, d):
    """Pixels that differ after mask -> contours -> mask."""
    first = _masks(spark, d)
    again = masks.labels_to_masks(masks.trace(first, {255: 0, 128: 1}, 0), _tiles(spark, d), {0: 255, 1: 128})

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"tile": b.tile, "n_set": [int((np.frombuffer(x, np.uint8) > 0).sum()) for x in b["data"]], "n_changed": [int((np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)).sum()) for x, y in zip(b["data"], b["again"])]})

    both = first.join(again.select("tile", F.col("data").alias("again")), "tile")
    return both.select("tile", "data", "again").mapInPandas(run, "tile string, n_set long, n_changed long")


@query(f"with {views.PX} select cast(raster_id as varchar) as raster_id, 1 as band, cast(y as integer) as y, cast(x as integer) as x, v from px")
def geotiff_roundtrip(spark, d):
    """The surrogate rasters as GeoTIFF bytes, read back in tiles, as pixels."""
    px = views.px(spark, d).select(F.col("raster_id").cast("string").alias("raster_id"), F.lit(1).alias("band"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
    blobs = readers.pixels_to_tiff(px, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], 26910, -9999.0, "float64")
    return readers.tile_pixels(readers.decode_tiles(blobs.select(F.regexp_replace("name", r"\.tif$", "").alias("stem"), "content"), 32))


@query(f"""with {views.PX}, t as (select raster_id, x // 32 as tx, y // 32 as ty, avg(cast(cast(v as real) as double)) as m from px group by all)
select raster_id || '.tif_x' || tx || '_y' || ty as tile, case when m > 0 then 1 else 0 end as cls, round(m, 4) as conf from t""")
def tile_inference(spark, d):
    """A stand-in model (mean of a tile's pixels, told apart by sign) over tiles."""
    px = views.px(spark, d).select(F.col("raster_id").cast("string").alias("raster_id"), F.lit(1).alias("band"), "y", "x", "v")
    tiles = readers.decode_tiles(readers.pixels_to_tiff(px, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]).select("name", "content").withColumnRenamed("name", "stem"), 32)

    def load():
        def model(b):
            means = [float(np.frombuffer(x, "<f4").astype("float64").mean()) for x in b["data"]]
            return pd.DataFrame({"tile": [f"{r}_x{x}_y{y}" for r, x, y in zip(b.raster_id, b.tile_x, b.tile_y)], "cls": [int(m > 0) for m in means], "conf": [round(m, 4) for m in means]})

        return model

    return masks.run_model(tiles, load, "tile string, cls int, conf double")


_LOGIT = "4 * (" + " + ".join(f"cast(embedding[{k + 1}] as double) * sin({k * 256} + {{y}} * 16 + {{x}})" for k in range(4)) + ")"


def _tap(y: str, x: str) -> str:
    return f"(1 / (1 + exp(-({_LOGIT.format(y=y, x=x)}))))"


@query(f"""with d as (select vec_id as det, label as cls, embedding, greatest(0, cast(round_even(cast(embedding[1] as double) * 100 + 60, 0) as bigint)) as xa, least(160, cast(round_even(cast(embedding[1] as double) * 100 + 100, 0) as bigint)) as xb,
  greatest(0, cast(round_even(cast(embedding[2] as double) * 100 + 60, 0) as bigint)) as ya, least(160, cast(round_even(cast(embedding[2] as double) * 100 + 100, 0) as bigint)) as yb from embeddings),
r as (select det, cls, embedding, xa, xb, unnest(range(ya, yb)) as y from d where xb > xa and yb > ya), p as (select det, cls, embedding, y, unnest(range(xa, xb)) as x from r),
q as (select *, greatest(0.0, least(15.0, (y + 0.5) * 16 / 160 - 0.5)) as sy, greatest(0.0, least(15.0, (x + 0.5) * 16 / 160 - 0.5)) as sx from p),
f as (select *, floor(sy) as y0, floor(sx) as x0, least(15, floor(sy) + 1) as y1, least(15, floor(sx) + 1) as x1, sy - floor(sy) as fy, sx - floor(sx) as fx from q),
u as (select det, cls, ({_tap('y0', 'x0')} * (1 - fy) + {_tap('y1', 'x0')} * fy) * (1 - fx) + ({_tap('y0', 'x1')} * (1 - fy) + {_tap('y1', 'x1')} * fy) * fx as v from f)
select det, cls, count(*) as n from u where v > 0.5 group by det, cls having count(*) >= 100""")
def mask_instances(spark, d):
    e = views.boxes(spark, d).join(views.table(spark, d, "embeddings").select(F.col("vec_id").alias("det"), F.slice("embedding", 1, 4).cast("array<double>").alias("coef")), "det")
    det = e.select("det", "cls", "conf", (F.col("x1") + 60).alias("x1"), (F.col("y1") + 60).alias("y1"), (F.col("x2") + 60).alias("x2"), (F.col("y2") + 60).alias("y2"), "coef")
    proto = np.sin(np.arange(4 * 16 * 16)).reshape(4, 16, 16) * 4
    return masks.decode_instances(det, proto, 160, 100).groupBy("det", "cls").agg(F.count(F.lit(1)).alias("n"))


@query()
def skeleton_arcs(spark, d):
    """Polylines along each tile's ridge pixels (best effort)."""

    def run(batches):
        for b in batches:
            for t, x in zip(b.tile, b["data"]):
                lines = masks.skeleton_lines(np.frombuffer(x, np.uint8).reshape(64, 64) == 255, 1.0)
                yield pd.DataFrame({"tile": [t], "n_lines": [len(lines)], "n_points": [sum(map(len, lines))]})

    return _masks(spark, d).mapInPandas(run, "tile string, n_lines long, n_points long")


@query()
def dataset_workflow(spark, d):
    """The dataset chain over the surrogate rasters and masks of their high ground: its report."""
    px = views.px(spark, d).withColumn("raster_id", F.col("raster_id").cast("string"))
    size = px.groupBy("raster_id").agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))
    tiles = size.select(F.col("raster_id").alias("tile"), "h", "w")

    def run(part):
        out = np.zeros((part.y.max() + 1, part.x.max() + 1), np.uint8)
        hit = part[part.v > 0]
        out[hit.y, hit.x] = 255
        return pd.DataFrame({"tile": [part.raster_id.iloc[0]], "h": [out.shape[0]], "w": [out.shape[1]], "data": [out.tobytes()]})

    found = px.groupBy("raster_id").applyInPandas(run, masks.MASK)
    return workflow.build_dataset(px, found, tiles).report


def _utm_sql() -> str:
    """Easting and northing of lon, lat in the zone z, step by step."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = grid.RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    x = "eta" + "".join(f" + {c!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(grid.utm_inverse_series(), 1))
    y = "xi" + "".join(f" + {c!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(grid.utm_inverse_series(), 1))
    return f"""t0 as (select *, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) as t, radians(lon - (z * 6 - 183)) as lam from pts),
t1 as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from t0),
t2 as (select *, 500000 + {0.9996 * a!r} * ({x}) as easting, case when lat < 0 then 1e7 else 0 end + {0.9996 * a!r} * ({y}) as northing from t1)"""


@query(f"""with pts as (select s_suppkey, s_acctbal / 60 as lon, s_nationkey * 2.5 - 30 as lat, cast(floor((s_acctbal / 60 + 180) / 6) as bigint) + 1 as z from supplier), {_utm_sql()}
select s_suppkey, case when z between 1 and 60 then z + 26900 end as epsg, case when z between 1 and 60 then round(easting, 3) end as easting, case when z between 1 and 60 then round(northing, 3) end as northing from t2""")
def reproject_points(spark, d):
    """Easting and northing of points in the zone of their longitude."""
    s = views.table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 60).alias("lon"), (F.col("s_nationkey") * 2.5 - 30).alias("lat"))
    s = s.withColumn("epsg", grid.utm_epsg(F.col("lon")))
    return s.select("s_suppkey", "epsg", grid.to_utm(F.col("lon"), F.col("lat"), F.col("epsg") - 26900).alias("p")).select("s_suppkey", "epsg", F.round("p.easting", 3).alias("easting"), F.round("p.northing", 3).alias("northing"))


_HREFS = r'''list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1), lambda v: v <> '')'''


@query(f"""with l as (select page_id, {_HREFS} as links from pages), e as (select page_id, unnest(range(1, len(links) + 1)) as i, links from l)
select page_id, 'page_' || lpad(cast(i as varchar), 4, '0') || case when regexp_extract(lower(regexp_replace(links[i], '[?#].*$', '')), '\\.(jpg|jpeg|png|gif|webp|bmp)$', 0) = '' then '.jpg'
  else regexp_extract(lower(regexp_replace(links[i], '[?#].*$', '')), '\\.(jpg|jpeg|png|gif|webp|bmp)$', 0) end as name from e""")
def download_names(spark, d):
    """Numbered names of a page's links, as its images would be named."""
    p = views.table(spark, d, "pages").select("page_id", F.posexplode(text.tag_attributes(F.col("html"), "a", "href")).alias("k", "u"))
    return p.select("page_id", text.download_name("page", F.col("k") + 1, F.col("u")).alias("name"))


@query(f"""with l as (select page_id, {_HREFS} as links from pages) select page_id, len(links) as n_body, len(list_distinct(links)) as n_distinct from l""")
def article_manifest(spark, d):
    """Images of each page's manifest: all, and distinct."""
    links = text.tag_attributes(F.col("html"), "a", "href")
    p = views.table(spark, d, "pages").select("page_id", F.to_json(F.struct(F.array().cast("array<string>").alias("cover_images"), links.alias("body_images"))).alias("manifest"))
    body = F.from_json("manifest", "cover_images array<string>, body_images array<string>")["body_images"]
    return p.select("page_id", F.size(body).cast("long").alias("n_body"), F.size(F.array_distinct(body)).cast("long").alias("n_distinct"))


@query(f"""with {views.IMAGES}, r as (select stem, count(*) as k from imgs group by stem), s as (select l.stem from lbls l join r on l.stem = r.stem)
select (select count(*) from imgs) as tiles, (select count(*) from lbls) as labels, (select count(*) from s) as samples""")
def workflow_counts(spark, d):
    parts = {"tiles": views.images(spark, d), "labels": views.label_files(spark, d), "samples": label_samples(spark, d)}
    rows = [f.groupBy().agg(*[(F.count(F.lit(1)) if k == name else F.lit(0)).cast("long").alias(k) for k in parts]) for name, f in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).agg(*[F.sum(k).alias(k) for k in parts])


@query("""with src as (select 0 as raster_id, o_orderkey // 256 as y, o_orderkey % 256 as x, o_totalprice as f from orders), """ + views.GRADIENTS + """
select y, x, round(dx, 2) as dx, round(dy, 2) as dy, round(curv, 2) as curv from grad""")
def big_gradients(spark, d):
    """Gradients of all orders as one raster."""
    px = views.table(spark, d, "orders").select(F.lit(0).alias("raster_id"), F.floor(F.col("o_orderkey") / 256).alias("y"), (F.col("o_orderkey") % 256).alias("x"), F.col("o_totalprice").alias("v"))
    return raster.gradients(px).select("y", "x", *[F.round(c, 2).alias(c) for c in ("dx", "dy", "curv")])
