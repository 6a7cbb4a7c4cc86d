"""Queries of whole chains and of smaller operators: line geometry, warps, rendering, audits, logs, names."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from geoloom.functions import color, grid, text
from geoloom.operators import detect, files, labels, raster, vector, workflow
from geoloom.plans import views
from geoloom.plans.registry import query
from geoloom.sources import logs, readers

# --- line geometry

#: Lines of two segments, placed by a vector's first elements.
_LINES = """lines as (select vec_id as fid, label as grid_code, cast(embedding[1] as double) * 100 as ax, cast(embedding[2] as double) * 100 as ay,
  cast(embedding[1] as double) * 100 + cast(embedding[3] as double) * 60 as bx, cast(embedding[2] as double) * 100 + 9 as by_,
  cast(embedding[1] as double) * 100 + cast(embedding[4] as double) * 40 as cx, cast(embedding[2] as double) * 100 + 18 as cy from embeddings),
seg as (select fid, grid_code, ax as x1, ay as y1, bx as x2, by_ as y2 from lines union all select fid, grid_code, bx, by_, cx, cy from lines)"""


def _lines(spark, d):
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    x, y = e[0] * 100, e[1] * 100

    def point(px, py):
        return F.struct(px.alias("x"), py.alias("y"))

    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("fid"), F.col("label").cast("int").alias("grid_code"), F.array(F.array(point(x, y), point(x + e[2] * 60, y + 9), point(x + e[3] * 40, y + 18))).alias("parts"))


def _side(p: str, q: str, r: str) -> str:
    return f"sign(({q}.0 - {p}.0) * ({r}.1 - {p}.1) - ({q}.1 - {p}.1) * ({r}.0 - {p}.0))".replace(".0", "x").replace(".1", "y")


def _within(p: str, q: str, r: str) -> str:
    return f"({r}x between least({p}x, {q}x) and greatest({p}x, {q}x) and {r}y between least({p}y, {q}y) and greatest({p}y, {q}y))"


_MEET = f"""sides as (select a.fid as a, b.fid as b, a.x1 as px, a.y1 as py, a.x2 as qx, a.y2 as qy, b.x1 as rx, b.y1 as ry, b.x2 as sx, b.y2 as sy
  from seg a join seg b on a.grid_code = b.grid_code and a.fid < b.fid and least(a.x1, a.x2) <= greatest(b.x1, b.x2) and least(b.x1, b.x2) <= greatest(a.x1, a.x2) and least(a.y1, a.y2) <= greatest(b.y1, b.y2) and least(b.y1, b.y2) <= greatest(a.y1, a.y2)),
turns as (select *, {_side('p', 'q', 'r')} as s1, {_side('p', 'q', 's')} as s2, {_side('r', 's', 'p')} as s3, {_side('r', 's', 'q')} as s4 from sides),
met as (select distinct a, b from turns where (s1 * s2 <= 0 and s3 * s4 <= 0 and not (s1 = 0 and s2 = 0 and s3 = 0 and s4 = 0))
  or (s1 = 0 and {_within('p', 'q', 'r')}) or (s2 = 0 and {_within('p', 'q', 's')}) or (s3 = 0 and {_within('r', 's', 'p')}) or (s4 = 0 and {_within('r', 's', 'q')}))"""


@query(f"with {_LINES}, {_MEET} select a, b from met")
def line_intersections(spark, d):
    return vector.line_pairs(_lines(spark, d), 25.0)


@query(f"""with recursive {_LINES}, {_MEET}, ways as (select a, b from met union select b, a from met),
ordered as (select fid, grid_code, row_number() over (partition by grid_code order by fid) as r from lines),
near as (select o.fid, o.grid_code, o.r, coalesce(list(p.b) filter (p.b is not null), []) as bs from ordered o left join ways p on p.a = o.fid group by o.fid, o.grid_code, o.r),
walk as (select grid_code, r, [fid] as kept, fid, true as keep from near where r = 1
  union all select n.grid_code, n.r, case when list_has_any(n.bs, w.kept) then w.kept else list_append(w.kept, n.fid) end, n.fid, not list_has_any(n.bs, w.kept) from walk w join near n on n.grid_code = w.grid_code and n.r = w.r + 1),
kept as (select fid from walk where keep),
base as (select n.fid, coalesce((select min(k.fid) from kept k where k.fid = n.fid), (select min(k.fid) from kept k where list_contains(n.bs, k.fid))) as base from near n)
select b.base as fid, any_value(l.grid_code) as grid_code, count(*) as members, count(*) as n_parts, round(sum(m.ax + m.bx), 4) as total_x from base b join lines m on m.fid = b.fid join lines l on l.fid = b.base group by b.base""")
def dissolve_lines(spark, d):
    """Greedy dissolve by real intersection; each base's parts are its members' lines."""
    out = vector.dissolve(_lines(spark, d), 25.0)
    x = F.aggregate(F.flatten(F.transform("parts", lambda p: F.array(p[0]["x"], p[1]["x"]))), F.lit(0.0), lambda a, v: a + v)
    return out.select("fid", "grid_code", "members", F.size("parts").cast("long").alias("n_parts"), F.round(x, 4).alias("total_x"))


@query("""with l as (select vec_id, case when vec_id % 9 = 0 then [] else list_transform(embedding[1:16], lambda e: cast(e as double) * 100) end as c from embeddings),
seg as (select vec_id, unnest(range(0, 7)) as k, c from l where len(c) > 0),
len as (select sum(sqrt(pow(c[2 * k + 3] - c[2 * k + 1], 2) + pow(c[2 * k + 4] - c[2 * k + 2], 2))) * 2.0 as total from seg)
select round((select total from len), 3) as total, count(*) filter (len(c) > 0) as valid, count(*) filter (len(c) = 0) as skipped from l""")
def length_totals(spark, d):
    c = F.transform(F.slice("embedding", 1, 16), lambda v: v.cast("double") * 100)
    points = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(F.element_at(c, 2 * k + 1).alias("x"), F.element_at(c, 2 * k + 2).alias("y")))
    e = views.table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 9 != 0, points).alias("p"))
    return vector.length_summary(e, "p", 2.0).withColumn("total", F.round("total", 3))


@query("select o_orderkey as fid, o_custkey as u, 1 as keep_me from orders")
def pass_fields(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("fid"), F.col("o_custkey").alias("u"), F.lit(1).alias("keep_me"), *[F.lit(0).alias(c) for c in ("Len_M", "LP_LEN", "loop_rm", "RM_CODE_1")])
    return vector.skip_pass_fields(o)


# --- rasters on other grids

_HEADERS = "heads as (select raster_id, 1000.0 + 7 * raster_id as x0, 5000.0 - 3 * raster_id as y0, max(x) + 1 as w, max(y) + 1 as h from px group by raster_id)"


def _headers(px):
    gt = F.array(F.lit(1000.0) + 7 * F.col("raster_id"), F.lit(10.0), F.lit(0.0), F.lit(5000.0) - 3 * F.col("raster_id"), F.lit(0.0), F.lit(-10.0))
    return px.groupBy("raster_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h")).withColumn("gt", gt)


def _target(res: float) -> str:
    return f"""grid as (select *, cast(round((x1 - x0t) / {res}) as bigint) as tw, cast(round((y1 - y0t) / {res}) as bigint) as th from (
  select *, floor(x0 / {res}) * {res} as x0t, ceil((x0 + w * 10) / {res}) * {res} as x1, floor((y0 - h * 10) / {res}) * {res} as y0t, ceil(y0 / {res}) * {res} as y1 from heads)),
cells as (select *, unnest(range(0, tw)) as x from (select *, unnest(range(0, th)) as y from grid)),
place as (select raster_id, x, y, w, h, (x0t + (x + 0.5) * {res} - x0) / 10 as u, (y0 - (y1 - (y + 0.5) * {res})) / 10 as v from cells)"""


@query(f"""with {views.PXN}, px as (select * from pxn), {_HEADERS}, {_target(24.0)},
t as (select *, u - 0.5 as su, v - 0.5 as sv, unnest([0, 1]) as dx from place where u >= 0 and u < w and v >= 0 and v < h), taps as (select *, unnest([0, 1]) as dy from t),
k as (select raster_id, x, y, greatest(0, least(floor(su) + dx, w - 1)) as sx, greatest(0, least(floor(sv) + dy, h - 1)) as sy,
  case when dx = 1 then su - floor(su) else 1 - (su - floor(su)) end * case when dy = 1 then sv - floor(sv) else 1 - (sv - floor(sv)) end as wt from taps),
f as (select k.raster_id, k.y, k.x, sum(wt * v) / sum(wt) as v from k join pxn p on p.raster_id = k.raster_id and p.x = k.sx and p.y = k.sy where wt > 0 and p.v <> -9999 group by k.raster_id, k.y, k.x)
select a.raster_id, a.y, a.x, round(coalesce(f.v, -9999), 5) as v from place a left join f using (raster_id, y, x)""")
def warp_aligned(spark, d):
    """Bilinear onto pixels of 24 units that are aligned to multiples of their size."""
    px = views.px(spark, d, True)
    heads = _headers(px)
    return raster.warp(px, heads, raster.aligned_grid(heads, 24.0, 24.0)).withColumn("v", F.round("v", 5))


@query(f"""with {views.PX}, {_HEADERS}, cells as (select *, unnest(range(0, 40)) as x from (select *, unnest(range(0, 30)) as y from heads)),
place as (select raster_id, x, y, w, h, (990.0 + (x + 0.5) * 17 - x0) / 10 as u, (y0 - (5010.0 - (y + 0.5) * 17)) / 10 as v from cells)
select a.raster_id, a.y, a.x, coalesce(p.v, 0.0) as v from place a left join px p on p.raster_id = a.raster_id and u >= 0 and u < w and a.v >= 0 and a.v < h and p.x = floor(u) and p.y = floor(a.v)""")
def warp_template(spark, d):
    """Nearest onto a template grid of other origin and resolution; background 0 outside."""
    px = views.px(spark, d)
    heads = _headers(px)
    gt = F.array(*[F.lit(v) for v in (990.0, 17.0, 0.0, 5010.0, 0.0, -17.0)])
    return raster.warp(px, heads, heads.select("raster_id", gt.alias("gt"), F.lit(40).alias("w"), F.lit(30).alias("h")), bilinear=False, background=0.0)


def _inverse_sql() -> str:
    """lon, lat of easting e and northing n in zone 10, step by step."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    x = "xi" + "".join(f" - {b!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, b in enumerate(beta, 1))
    y = "eta" + "".join(f" - {b!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, b in enumerate(beta, 1))
    steps = [f"i0 as (select *, n / {0.9996 * a!r} as xi, (e - 500000) / {0.9996 * a!r} as eta from pts)", f"i1 as (select *, {x} as xx, {y} as yy from i0)", "i2 as (select *, asinh(sin(xx) / sqrt(sinh(yy) * sinh(yy) + cos(xx) * cos(xx))) as psi from i1)", "j0 as (select *, asin(tanh(psi)) as phi from i2)"]
    steps += [f"j{k} as (select * exclude (phi), asin(tanh(psi + {e!r} * atanh({e!r} * sin(phi)))) as phi from j{k - 1})" for k in range(1, 5)]
    return ", ".join(steps) + ", ll as (select *, degrees(atan2(sinh(yy), cos(xx))) + 10 * 6 - 183 as lon, degrees(phi) as lat from j4)"


@query(f"""with {views.PX}, heads as (select raster_id, max(x) + 1 as w, max(y) + 1 as h from px group by raster_id),
cells as (select *, unnest(range(0, 24)) as x from (select *, unnest(range(0, 18)) as y from heads)), pts as (select *, 540000.0 + (x + 0.5) * 250 as e, 5100000.0 - (y + 0.5) * 250 as n from cells), {_inverse_sql()},
place as (select raster_id, y, x, w, h, (lon + 122.5) / 0.001 as u, (46.06 - lat) / 0.001 as v from ll)
select a.raster_id, a.y, a.x, coalesce(p.v, -9999.0) as v from place a left join px p on p.raster_id = a.raster_id and u >= 0 and u < w and a.v >= 0 and a.v < h and p.x = floor(u) and p.y = floor(a.v)""")
def warp_to_utm(spark, d):
    """Rasters in degrees onto a grid of metres in zone 10, through the inverse projection of each target pixel."""
    px = views.px(spark, d)
    heads = px.groupBy("raster_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    src = heads.withColumn("gt", F.array(*[F.lit(v) for v in (-122.5, 0.001, 0.0, 46.06, 0.0, -0.001)]))
    dst = heads.select("raster_id", F.array(*[F.lit(v) for v in (540000.0, 250.0, 0.0, 5100000.0, 0.0, -250.0)]).alias("gt"), F.lit(24).alias("w"), F.lit(18).alias("h"))
    return raster.warp(px, src, dst, bilinear=False, to_source=lambda e, n: grid.from_utm(e, n, F.lit(10)))


@query(f"with {views.PX} select raster_id, y, x, round(avg(v), 6) as v from (select raster_id, y, x, unnest([v, v * 2, v + x]) as v from px) group by raster_id, y, x")
def band_mean(spark, d):
    v = F.col("v")
    px = views.px(spark, d).select("raster_id", "y", "x", F.posexplode(F.array(v, v * 2, v + F.col("x"))).alias("band", "v"))
    return raster.band_mean(px).withColumn("v", F.round("v", 6))


_OK = """ok0 as (select *, min(cast(v <> -9999 as integer)) over (partition by raster_id, y order by x range between 1 preceding and 1 following) as o from pxn),
ok as (select *, min(o) over (partition by raster_id, x order by y range between 1 preceding and 1 following) as on_ from ok0)"""
_RGB = [re.sub(r"case when v <> -9999 and", "case when on_ = 1 and", c) for c in color.sql_elevation("v", "lo", "hi", "terrain")]
_BLEND = color.sql_blend("r", "g", "b", "shade", 1.5).replace("round(greatest", "(greatest").replace(", 4) as out", ") as out")
_SHADED = "cos(radians(45.0)) * cos(slope) + sin(radians(45.0)) * sin(slope) * cos(radians(135.0) - aspect)"


@query(f"""with {views.PXN}, {_OK}, src as (select raster_id, y, x, v, on_, v as f from ok), {views.GRADIENTS},
e as (select raster_id, min(v) filter (on_ = 1) as lo, max(v) filter (on_ = 1) as hi from ok group by raster_id),
s as (select *, atan(sqrt(dx * dx / 6400 + dy * dy / 6400)) as slope, atan2(dy / 80, -dx / 80) as a0 from grad join e using (raster_id)),
t as (select *, case when a0 < 0 then a0 + 2 * pi() else a0 end as aspect from s),
c as materialized (select raster_id, y, x, on_, {_RGB[0]} as r, {_RGB[1]} as g, {_RGB[2]} as b, case when on_ = 1 then greatest(0, least(1, {_SHADED})) else 0 end as shade from t),
m as (select raster_id, y, x, on_, {_BLEND} from c)
select raster_id, count(*) as n, sum(on_)::bigint as n_clear, {', '.join(f"sum(case when on_ = 1 then cast(floor(out_{k} * 255) as bigint) else 0 end)::bigint as {k}" for k in 'rgb')} from m group by raster_id""")
def render_rgba(spark, d):
    """The whole render from pixels to RGBA; the sums of its bytes."""
    out = raster.render(views.px(spark, d, True), 10, "terrain", boost=1.5)
    return out.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") == 255).cast("long")).alias("n_clear"), *[F.sum(F.col(c).cast("long")).alias(c) for c in "rgb"])


# --- tiles, models and labels

_MODEL = """tile as (select raster_id, x, y, v, x // 32 as tx, y // 32 as ty, 100 * (y // 32) + x // 32 as seq from px),
part as (select raster_id, tx, ty, avg(case when v > 0 then 1.0 else 0.0 end) as hot, avg(case when v > 300 then 1.0 else 0.0 end) * 4 as very from tile group by all),
found as (select t.raster_id, 2 * seq as seq, y, x, 0 as cls, hot as conf from tile t join part p using (raster_id, tx, ty) where v > 0
  union all select t.raster_id, 2 * seq + 1, y, x, 1, very from tile t join part p using (raster_id, tx, ty) where v > -100 and x % 2 = 0)"""


def _inference(spark, d):
    px = views.px(spark, d).select(F.col("raster_id").cast("string").alias("raster_id"), F.lit(1).alias("band"), "y", "x", "v")
    blobs = readers.pixels_to_tiff(px, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], dtype="float64")
    tiles = readers.decode_tiles(blobs.select(F.regexp_replace("name", r"\.tif$", "").alias("stem"), "content"), 32)

    def load():
        import numpy as np
        import pandas as pd

        def model(b):
            out = []
            for t in b.itertuples():
                v = np.frombuffer(t.data, "<f8").reshape(int(t.h), int(t.w))
                ys, xs = np.indices(v.shape)
                xs, ys, seq = xs + int(t.x_off), ys + int(t.y_off), 100 * int(t.tile_y) + int(t.tile_x)
                for k, (hit, conf) in enumerate((((v > 0), (v > 0).mean()), ((v > -100) & (xs % 2 == 0), (v > 300).mean() * 4))):
                    out.append(pd.DataFrame({"raster_id": t.raster_id, "seq": 2 * seq + k, "y": ys[hit], "x": xs[hit], "cls": k, "conf": float(conf)}))
            return pd.concat(out)

        return model

    return workflow.infer(tiles, load)


@query(f"""with {views.PX}, {_MODEL}, r as (select *, row_number() over (partition by raster_id, y, x order by conf desc, seq) as k from found where conf > 0)
select raster_id::varchar as raster_id, y, x, cls + 1 as cls, round(conf, 6) as conf from r where k = 1""")
def infer_classes(spark, d):
    """Tiles to a stand-in model to the merged class raster."""
    return _inference(spark, d).classes.withColumn("conf", F.round("conf", 6))


@query(f"with {views.PX}, {_MODEL} select raster_id::varchar as raster_id, y, x, cls, round(max(conf), 6) as conf from found group by raster_id, y, x, cls")
def infer_confidence(spark, d):
    return _inference(spark, d).confidence.withColumn("conf", F.round("conf", 6))


_TILE_GRID = "tiles as (select raster_id, raster_id * 100 + t as tile, 1000.0 + 7 * raster_id + (t % 3) * 200 as tx0, 5000.0 - 3 * raster_id - (t // 3) * 150 as ty0 from heads, (select unnest(range(0, 6)) as t))"


def _mask_tiles(spark, d):
    px = views.px(spark, d).withColumn("v", F.when(F.col("v") > 500, 255.0).when(F.col("v") > 200, 128.0).otherwise(0.0))
    heads = _headers(px)
    t = heads.select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("t"))
    gt = F.array(F.lit(1000.0) + 7 * F.col("raster_id") + (F.col("t") % 3) * 200, F.lit(5.0), F.lit(0.0), F.lit(5000.0) - 3 * F.col("raster_id") - F.floor(F.col("t") / 3) * 150, F.lit(0.0), F.lit(-5.0))
    return px, heads, t.select("raster_id", (F.col("raster_id") * 100 + F.col("t")).cast("string").alias("tile"), gt.alias("gt"), F.lit(40).alias("w"), F.lit(30).alias("h"))


@query(f"""with {views.PX}, {_HEADERS}, {_TILE_GRID}, cells as (select *, unnest(range(0, 40)) as x from (select *, unnest(range(0, 30)) as y from tiles)),
spot as (select c.*, floor((tx0 + (c.x + 0.5) * 5 - x0) / 10) as sx, floor((y0 - (ty0 - (c.y + 0.5) * 5)) / 10) as sy from cells c join heads using (raster_id))
select tile::varchar as tile, count(*) filter (p.v > 500)::bigint as n_255, count(*) filter (p.v > 200 and p.v <= 500)::bigint as n_128 from spot s left join px p on p.raster_id = s.raster_id and p.x = s.sx and p.y = s.sy group by tile""")
def mask_tiles(spark, d):
    """Large masks on the grids of tiles: pixels of each class."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            v = [np.frombuffer(x, np.uint8) for x in b["data"]]
            yield pd.DataFrame({"tile": b.tile, "n_255": [int((x == 255).sum()) for x in v], "n_128": [int((x == 128).sum()) for x in v]})

    return workflow.tile_masks(*_mask_tiles(spark, d)).mapInPandas(run, "tile string, n_255 long, n_128 long")


@query()
def mask_tile_labels(spark, d):
    """Label files of tiles from large masks."""
    return workflow.mask_labels(*_mask_tiles(spark, d))


@query()
def vector_tile_labels(spark, d):
    """Label files of tiles from line features and their buffers."""
    lines = _lines(spark, d).select("fid", F.struct(F.lit("LineString").alias("type"), F.col("parts").alias("parts")).alias("geom"), F.when(F.col("grid_code") % 2 == 0, 255).otherwise(128).alias("grid_code"))
    t = spark.range(36)
    gt = F.array((F.col("id") % 6 - 3) * 64.0, F.lit(1.0), F.lit(0.0), (F.floor(F.col("id") / 6) - 2) * 64.0, F.lit(0.0), F.lit(-1.0))
    tiles = t.select(F.col("id").cast("string").alias("tile"), F.lit(64).alias("h"), F.lit(64).alias("w"), gt.alias("gt"))
    return workflow.vector_labels(lines, tiles, line_radius=2.0, cell=64.0)


# --- datasets and audits


@query(f"""with {views.LABEL_LINES}, img as (select distinct 't' || (l_orderkey % 450) as stem, case when l_orderkey % 450 % 41 = 0 then null when l_orderkey % 450 % 17 = 0 then 0.5 else 30.0 end as std from lineitem),
files as (select distinct stem from lines where cast(substr(stem, 2) as integer) % 13 <> 0),
w as (select stem, line_no, list_filter(string_split_regex(trim(line), '\\s+'), lambda t: t <> '') as w from lines), n as (select *, list_transform(w, lambda t: try_cast(t as double)) as v from w where len(w) > 0),
bad as (select stem, line_no, case when len(w) < 5 then 'too_few' when len(list_filter(v, lambda x: x is null)) > 0 then 'not_numeric' when len(list_filter(v[2:], lambda x: x < 0 or x > 1)) > 0 then 'out_of_range' end as issue from n)
select stem, null::bigint as line_no, 'unreadable' as issue from img where std is null union all select stem, null, 'solid_colour' from img where std < 1
union all select stem, null, 'missing_label' from img where std is not null and stem not in (select stem from files)
union all select stem, line_no, issue from bad where issue is not null and stem in (select stem from img where std is not null) and stem in (select stem from files)""")
def validate_images(spark, d):
    """Validator A over images, label files and lines."""
    k = (F.col("l_orderkey") % 450).cast("int")
    std = F.when(k % 41 == 0, F.lit(None)).when(k % 17 == 0, F.lit(0.5)).otherwise(F.lit(30.0))
    images = views.table(spark, d, "lineitem").select(F.concat(F.lit("t"), k.cast("string")).alias("stem"), std.alias("std")).distinct()
    lines = views.label_lines(spark, d)
    have = lines.select("stem").distinct().filter(F.substr("stem", F.lit(2)).cast("int") % 13 != 0)
    return labels.validate_images(images, have, lines)


@query(f"""with {views.IMAGES}, i as (select distinct stem from imgs where lower(ext) in ('jpg', 'jpeg', 'png', 'bmp', 'gif')), n as (select count(*) as n from i),
r as (select stem, row_number() over (order by md5('42:' || stem), stem) as r from i), s as (select stem, case when r <= cast(floor(n * 0.2) as bigint) then 'val' else 'train' end as split from r, n),
m as (select stem, split, row_number() over (partition by split order by md5('42:' || stem), stem) as image_id from s),
a as (select stem, unnest(range(0, 1 + cast(stem as bigint) % 3)) as line_no from i)
select m.split, m.image_id, a.line_no, m.stem, row_number() over (partition by m.split order by m.image_id, a.line_no) as id from a join m on m.stem = a.stem""")
def coco_annotation_ids(spark, d):
    images = labels.annotated_images(views.images(spark, d)).select("stem").distinct()
    split = labels.random_split(images, 0.2, floor=True)
    lines = images.select("stem", F.explode(F.sequence(F.lit(0), (F.col("stem").cast("int") % 3))).alias("line_no"))
    return labels.coco_ids(split, lines)[1].select("split", "image_id", F.col("line_no").cast("long").alias("line_no"), "stem", "id")


@query(f"with {views.BOXES}, r as (select cls as tile, det, conf, row_number() over (partition by cls order by conf desc, det) as r from boxes) select tile, det, conf from r where r <= 7")
def top_detections(spark, d):
    return labels.top_detections(views.boxes(spark, d).select(F.col("cls").alias("tile"), "det", "conf"), 7)


@query("""with l as (select 'Area_' || p_partkey || case p_partkey % 3 when 0 then '_Cleaned_mask' when 1 then '_BUFFER' else '' end as stem, 'shp/' || p_partkey as path, p_partkey from part where p_partkey % 5 <> 0),
r as (select 'Area_' || p_partkey || case p_partkey % 2 when 0 then '_mask' else '' end as stem, 'tif/' || p_partkey as path, p_partkey from part where p_partkey % 7 <> 0)
select 'Area_' || l.p_partkey as key, l.path as left_path, r.path as right_path from l join r on l.p_partkey = r.p_partkey""")
def suffix_join(spark, d):
    p, k = views.table(spark, d, "part"), F.col("p_partkey")
    name = F.concat(F.lit("Area_"), k.cast("string"))
    left = p.filter(k % 5 != 0).select(F.concat(name, F.when(k % 3 == 0, "_Cleaned_mask").when(k % 3 == 1, "_BUFFER").otherwise("")).alias("stem"), F.concat(F.lit("shp/"), k.cast("string")).alias("path"))
    right = p.filter(k % 7 != 0).select(F.concat(name, F.when(k % 2 == 0, "_mask").otherwise("")).alias("stem"), F.concat(F.lit("tif/"), k.cast("string")).alias("path"))
    return files.suffix_join(left, right, ["_buffer", "_cleaned", "_mask"])


@query("""with l as (select 'a' || c_custkey || case c_custkey % 4 when 0 then '_buffer' else '' end as stem, 'a' || c_custkey as output_name, c_custkey as k from customer),
f as (select case when c_custkey % 8 = 0 then 'a' || c_custkey || '_buffer' else 'a' || c_custkey end as folder from customer where c_custkey % 3 <> 0)
select l.stem, l.output_name, coalesce(a.folder, b.folder) as folder, case when coalesce(a.folder, b.folder) is null then 'no_folder' else 'matched' end as status
from l left join f a on a.folder = l.output_name left join f b on b.folder = l.stem""")
def tile_folders(spark, d):
    c, k = views.table(spark, d, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("a"), k.cast("string"))
    layers = c.select(F.concat(name, F.when(k % 4 == 0, "_buffer").otherwise("")).alias("stem"))
    folders = c.filter(k % 3 != 0).select(F.when(k % 8 == 0, F.concat(name, F.lit("_buffer"))).otherwise(name).alias("folder"))
    return files.tile_folders(layers, folders, ["_buffer"])


@query("""with f as (select 'd' || (c_custkey % 37) || '/' || c_custkey as path, 't' || (c_custkey % 25) || case c_custkey % 4 when 0 then '_1' when 1 then '_2' else '' end || '.tif' as name from customer where c_custkey < 600),
s as (select *, regexp_replace(name, '\\.tif$', '') as stem from f), o as (select *, row_number() over (partition by regexp_replace(stem, '(_[0-9]+)+$', '') order by path) as r, regexp_replace(stem, '(_[0-9]+)+$', '') as fam from s),
walk as (select fam, r, path, name as dst, [name] as taken from o where r = 1
  union all select o.fam, o.r, o.path, c.dst, list_append(w.taken, c.dst) from walk w join o on o.fam = w.fam and o.r = w.r + 1,
  lateral (select list_filter(list_concat([o.name], list_transform(range(1, 40), lambda k: o.stem || '_' || k || '.tif')), lambda x: not list_contains(w.taken, x))[1] as dst) c)
select 'copy' as action, path as src, dst from walk""".replace("with f", "with recursive f", 1))
def flatten_cascades(spark, d):
    """Names whose numbered copies collide with other files' own names."""
    c, k = views.table(spark, d, "customer").filter("c_custkey < 600"), F.col("c_custkey")
    name = F.concat(F.lit("t"), (k % 25).cast("string"), F.when(k % 4 == 0, "_1").when(k % 4 == 1, "_2").otherwise(""), F.lit(".tif"))
    return files.flatten_plan(c.select(F.concat(F.lit("d"), (k % 37).cast("string"), F.lit("/"), k.cast("string")).alias("path"), name.alias("name")))


@query(f"""with {views.IMAGES}, s as (select distinct l.stem from lbls l join imgs i on l.stem = i.stem), n as (select count(*) as n from s),
r as (select row_number() over (order by md5('42:' || stem), stem) as r from s)
select (select count(*) from imgs) as tiles, (select count(*) from imgs where ext = 'png') as rgb_images, (select count(*) from lbls) as labels,
 (select count(*) from r, n where r > round_even(n * 0.2, 0)) as train, (select count(*) from r, n where r <= round_even(n * 0.2, 0)) as val""")
def workflow_report(spark, d):
    images, found = views.images(spark, d), views.label_files(spark, d)
    split = labels.random_split(found.select("stem").join(images.select("stem").distinct(), "stem"), 0.2)
    return files.workflow_counts(images, images.filter("ext = 'png'"), found, split)


@query("select doc_id::varchar as stem, (len(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: trim(x, ' ') <> '')))::bigint as density from documents where text is not null")
def label_density(spark, d):
    docs = views.table(spark, d, "documents").filter("text is not null")
    return files.label_density(docs.select(F.col("doc_id").cast("string").alias("stem"), "text"))


@query(f"with {views.IMAGES} select distinct stem, path from imgs where ext in ('png', 'jpg')")
def union_globs(spark, d):
    images = views.images(spark, d)
    some = [images.filter(F.col("ext").isin(*e)).select("stem", "path") for e in (("png",), ("jpg", "png"), ("jpg",))]
    return files.union_distinct(*some)


@query("""select 'in/' || (c_custkey % 9) || '/r' || c_custkey || '.tif' as src, (c_custkey % 9) || '/r' || c_custkey || '_utm.tif' as dst, case when c_custkey % 4 = 0 then 'skipped_existing' else 'processed' end as status from customer""")
def batch_log(spark, d):
    c, k = views.table(spark, d, "customer"), F.col("c_custkey")
    inputs = c.select(F.concat(F.lit("in/"), (k % 9).cast("string"), F.lit("/r"), k.cast("string"), F.lit(".tif")).alias("path"), F.concat(F.lit("r"), k.cast("string")).alias("stem"), F.lit("tif").alias("ext"))
    done = c.filter(k % 4 == 0).select(F.concat((k % 9).cast("string"), F.lit("/r"), k.cast("string"), F.lit("_utm.tif")).alias("path"))
    return files.batch_log(inputs, done, "in/", "_utm")


# --- descriptors and logs

_EPT = """ept as (select event_id as prefix, case when event_id % 11 = 0 then null when event_id % 7 = 0 then '{"bounds": [1,' when event_id % 5 = 0 then '[1, 2]' else '{"bounds":[' || user_id || ',0,0,' || (user_id + 5) || ',9,9]}' end as json, user_id from events)"""


def _ept(spark, d):
    e, k, u = views.table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    good = F.concat(F.lit('{"bounds":['), u.cast("string"), F.lit(",0,0,"), (u + 5).cast("string"), F.lit(",9,9]}"))
    return e.select(k.alias("prefix"), F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, '{"bounds": [1,').when(k % 5 == 0, "[1, 2]").otherwise(good).alias("json"))


@query(f"""with {_EPT} select prefix, json is not null and prefix % 7 <> 0 and prefix % 5 <> 0 as ok, case when json is null then 'no such descriptor' when prefix % 7 = 0 or prefix % 5 = 0 then 'not a JSON object' end as error from ept""")
def cached_descriptors(spark, d):
    """Which descriptors can be read, and why not."""
    return logs.checked_json(_ept(spark, d)).select("prefix", "ok", "error")


@query(f"""with {_EPT}, s as (select prefix, json is not null and prefix % 7 <> 0 and prefix % 5 <> 0 as ok, user_id as u from ept)
select prefix, ok, case when ok then u::double end as xmin, case when ok then 0.0 end as ymin, case when ok then u + 5.0 end as xmax, case when ok then 9.0 end as ymax, ok and u <= 40 and u + 5 >= 20 as hit from s""")
def ept_scan(spark, d):
    return vector.ept_scan(logs.checked_json(_ept(spark, d)), 20, 3, 40, 5)


# --- names, pages, maps

_URL = ["a/b.png", "../x/./y.html?q=1", "/root/./p/../z", "//host.example/p", "https://o.example/x", "?k=2", "#f", "..", ""]


def _joined(base: str, url: str) -> str:
    from urllib.parse import urljoin

    return urljoin(base, url)


_JOINED = [(b, u, _joined(b, u)) for b in ("https://h.example/d/e/f.html", "http://h.example", "https://h.example/d/?q=1") for u in _URL]
_CASES = ", ".join("('" + "', '".join(r) + "')" for r in _JOINED)


@query(f"select page_id, t.base, t.url, t.want as full_url from pages, (values {_CASES}) as t(base, url, want) where page_id < 20")
def url_join(spark, d):
    """Addresses against their page; the values wanted are the standard library's."""
    rows = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(u).alias("url")) for b, u, _ in _JOINED])
    p = views.table(spark, d, "pages").filter("page_id < 20").select("page_id", F.explode(rows).alias("r")).select("page_id", "r.base", "r.url")
    return p.select("page_id", "base", "url", text.joined_url(F.col("base"), F.col("url")).alias("full_url"))


_IMG = """'<meta property="og:image" content="https://c.example/' || (page_id % 4) || '.png"><img class=x data-src="d' || (page_id % 6) || '.jpg" src="no.gif"><img src="s' || (page_id % 5) || '.png"><img data-original=''o.png'' src="no2.gif"><IMG alt="none">'"""


@query("""select page_id, list_sort(list_distinct(['https://c.example/' || (page_id % 4) || '.png', 'd' || (page_id % 6) || '.jpg', 's' || (page_id % 5) || '.png', 'o.png'])) as images from pages""")
def page_images(spark, d):
    """Image addresses of a page: preview, lazy sources, plain sources."""
    p = views.table(spark, d, "pages").withColumn("h", F.concat(F.expr(_IMG), F.col("html")))
    return p.select("page_id", text.page_images(F.col("h")).alias("images"))


@query("""select page_id, 'https://c.example/' || (page_id % 4) || '.png' as cover, 4 as n_images from pages""")
def page_manifest(spark, d):
    """Manifest of a page's cover and body images, read back from its JSON."""
    h = F.concat(F.expr(_IMG), F.col("html"))
    covers = text.page_images(F.regexp_extract(h, "(?is)^(<meta[^>]*>)", 1))
    p = views.table(spark, d, "pages").select("page_id", F.to_json(F.struct(covers.alias("cover_images"), text.page_images(h).alias("body_images"))).alias("m"))
    m = F.from_json("m", "cover_images array<string>, body_images array<string>")
    return p.select("page_id", m["cover_images"][0].alias("cover"), F.size(m["body_images"]).alias("n_images"))


@query("""select event_id, '{"t":"a/' || user_id || ' é"}' as found from events""")
def escaped_json(spark, d):
    r"""JSON in a script's string literal: \x22-like and \u escapes are undone."""
    html = F.concat(F.lit(r"<script>var m = '{\"t\":\"a\/"), F.col("user_id").cast("string"), F.lit(r" é\"}';</script>"))
    return views.table(spark, d, "events").select("event_id", text.embedded_json(html, ["none='(.*?)'", "m = '(.*?)';"], escaped=True).alias("found"))


@query("select n_nationkey, case n_nationkey % 3 when 0 then 255 when 1 then 128 end as value from nation")
def inverse_classes(spark, d):
    m = text.inverse_map(F.create_map(F.lit(255), F.lit(0), F.lit(128), F.lit(1)))
    return views.table(spark, d, "nation").select("n_nationkey", F.try_element_at(m, (F.col("n_nationkey") % 3).cast("int")).alias("value"))


@query("""select s_suppkey, case when s_suppkey % 3 = 0 then null else least(1000.0 + 10 * s_nationkey, 1000.0 + 10 * (s_nationkey - 4)) end as xmin,
  case when s_suppkey % 3 = 0 then null else greatest(500.0 - 10 * 3, 500.0 - 10 * 8) end as ymax from supplier""")
def pixel_boxes(spark, d):
    """Map boxes of pixel boxes with corners in any order; other arrays have none."""
    n = F.col("s_nationkey").cast("double")
    box = F.when(F.col("s_suppkey") % 3 == 0, F.array(n, n)).otherwise(F.array(n, F.lit(3.0), n - 4, F.lit(8.0)))
    gt = F.array(*[F.lit(v) for v in (1000.0, 10.0, 0.0, 500.0, 0.0, -10.0)])
    b = grid.geo_box(gt, box)
    return views.table(spark, d, "supplier").select("s_suppkey", b["xmin"].alias("xmin"), b["ymax"].alias("ymax"))


@query("select n_nationkey, case when n_nationkey between 0 and 20 then n_nationkey::double end as nodata from nation")
def nodata_carry(spark, d):
    n = F.col("n_nationkey")
    v = F.when(n <= 20, n.cast("double")).otherwise(F.when(n % 2 == 0, F.lit(-9999.0)).otherwise(F.lit(256.0)))
    return views.table(spark, d, "nation").select("n_nationkey", raster.carried_nodata(v).alias("nodata"))


@query(f"with {views.BOXES} select cls, det % 40 as y, count(*) as n from boxes group by cls, det % 40 having count(*) >= 2")
def instance_sizes(spark, d):
    b = views.boxes(spark, d).withColumn("y", F.col("det") % 40)
    return detect.small_instances(b, ["cls", "y"], 2)
