"""Queries of smaller raster, grid and layer operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import grid
from geoloom.operators import raster, vector
from geoloom.plans import views
from geoloom.plans.registry import query


@query(f"""with {views.PXN}, b as (select raster_id // 2 as raster_id, raster_id % 2 + 1 as band, y, x, case when v = -9999 then v else v / 1000 end as v from pxn),
n as (select raster_id, band, y, x, case when v <> -9999 then greatest(0, least(1, v)) else 0 end as v from b)
select raster_id, band, y, x, v::double as v from n union all select raster_id, 3, y, x, 0.0::double from n where band = 1""")
def normalise_hwc(spark, d):
    """Every two rasters as the bands of one, in three channels."""
    v = F.when(F.col("v") == -9999, F.col("v")).otherwise(F.col("v") / 1000)
    px = views.px(spark, d, True).select(F.floor(F.col("raster_id") / 2).alias("raster_id"), (F.col("raster_id") % 2 + 1).alias("band"), "y", "x", v.alias("v"))
    return raster.normalise_bands(px)


@query(f"with {views.PX}, f as (select raster_id, case when raster_id % 2 = 0 then v else 7.0 + v / 1000 end as v from px) select raster_id, round(stddev_pop(v), 6) as std from f group by raster_id having stddev_pop(v) < 1")
def solid_images(spark, d):
    v = F.when(F.col("raster_id") % 2 == 0, F.col("v")).otherwise(7.0 + F.col("v") / 1000)
    return raster.solid_images(views.px(spark, d).withColumn("v", v)).select("raster_id", F.round("std", 6).alias("std"))


@query(f"with {views.PXN} select raster_id, count(*) filter (v <> -9999) as n_valid, min(v) filter (v <> -9999) as lo, max(v) filter (v <> -9999) as hi, round(avg(v) filter (v <> -9999), 6) as mean from pxn group by raster_id")
def repaired_stats(spark, d):
    return raster.repaired_stats(views.px(spark, d, True)).select("raster_id", "n_valid", "lo", "hi", F.round("mean", 6).alias("mean"))


@query(f"with {views.PX} select raster_id, y, x, 255 - case when v > 0 then 255 else 128 end as v from px")
def invert_mask(spark, d):
    v = F.when(F.col("v") > 0, 255).otherwise(128)
    return views.px(spark, d).select("raster_id", "y", "x", raster.invert(v).alias("v"))


@query("select p_partkey, least(10.0::double, 10.0 + (w - 1) * 0.5) as xmin, least(90.0::double, 90.0 - (h - 1) * 0.25) as ymin, greatest(10.0::double, 10.0 + (w - 1) * 0.5) as xmax, greatest(90.0::double, 90.0 - (h - 1) * 0.25) as ymax from (select p_partkey, p_size * 3 as w, p_size * 2 as h from part)")
def geo_extent(spark, d):
    """The extent that an image's coordinate mapper holds, read back from its JSON."""
    gt = F.array(*[F.lit(v) for v in (10.0, 0.5, 0.0, 90.0, 0.0, -0.25)])
    p = views.table(spark, d, "part").select("p_partkey", grid.mapper_json(gt, F.lit("EPSG:26910"), F.col("p_size") * 3, F.col("p_size") * 2).alias("j"))
    e = F.from_json("j", "geo_extent struct<xmin:double,ymin:double,xmax:double,ymax:double>")["geo_extent"]
    return p.select("p_partkey", e.alias("e")).select("p_partkey", "e.*")


@query("select event_id, user_id, value from events where user_id between 20 and 60 and value between 10 and 90")
def point_bounds(spark, d):
    e = views.table(spark, d, "events").select("event_id", F.col("user_id").alias("px"), F.col("value").alias("py"))
    return vector.points_in_box(e, 20, 10, 60, 90).select("event_id", F.col("px").alias("user_id"), F.col("py").alias("value"))


@query("select n_name from nation where starts_with(n_name, 'NATION_1') or contains(n_name, '2')")
def prefix_filter(spark, d):
    return views.table(spark, d, "nation").filter(F.col("n_name").startswith("NATION_1") | F.col("n_name").contains("2")).select("n_name")


@query("select n_nationkey, case n_nationkey % 3 when 0 then 'LineString' when 1 then 'Polygon' else 'Point' end as kind from nation")
def geometry_types(spark, d):
    k = F.col("n_nationkey") % 3
    return views.table(spark, d, "nation").select("n_nationkey", vector.geometry_kind(F.when(k == 0, "POLYLINE").when(k == 1, "Polygon").otherwise("point")).alias("kind"))


@query(f"with {views.POLYGONS} select line_no, round(list_sum(list_transform(coords, lambda v: v * 100.0)), 6) as total, len(coords)::integer as n from poly")
def pixel_polygons(spark, d):
    from geoloom.operators import labels

    xy = labels.pixel_coords(F.col("coords"), F.lit(100.0), F.lit(100.0))
    return views.polygons(spark, d).select("line_no", F.round(F.aggregate(xy, F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.size(xy).alias("n"))
