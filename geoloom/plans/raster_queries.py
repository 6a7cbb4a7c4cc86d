"""Queries of the raster and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import color, grid
from geoloom.operators import raster
from geoloom.plans import views
from geoloom.plans.registry import query

OK = "v <> -9999 and not isnan(v) and not isinf(v)"


def _round(df, *names, n=6):
    return df.select(*[F.round(F.col(c), n).alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"with {views.PXN}, e as (select *, case when x = 5 then -6000.0 when x = 6 then 'nan'::double when x = 7 then 'infinity'::double else v end as raw from pxn) select raster_id, y, x, case when raw = -9999 or raw <= -5000 or isnan(raw) or isinf(raw) then -9999.0 else raw end as v from e")
def nodata_fix(spark, d):
    raw = F.when(F.col("x") == 5, F.lit(-6000.0)).when(F.col("x") == 6, F.lit(float("nan"))).when(F.col("x") == 7, F.lit(float("inf"))).otherwise(F.col("v"))
    return views.px(spark, d, True).withColumn("v", raster.fix_nodata(raw))


@query(f"""with {views.PX}, c as (select raster_id, y, x, case when abs(v) < 50 then 1.0 when abs(v) < 120 then 2.0 when raster_id = 3 and v > 300 then 300.0 else 0.0 end as v from px),
s as (select raster_id, y, x, case when v = 1 then 2.0 else v end as v from c), t as (select raster_id, y, x, case when v = 2 then 255.0 else v end as v from s)
select raster_id, y, x, cast(v as integer) as v from t where raster_id in (select raster_id from t group by raster_id having bool_and(v between 0 and 255))""")
def remap_values(spark, d):
    v = F.when(F.abs("v") < 50, F.lit(1.0)).when(F.abs("v") < 120, F.lit(2.0)).when((F.col("raster_id") == 3) & (F.col("v") > 300), F.lit(300.0)).otherwise(F.lit(0.0))
    return raster.remap(views.px(spark, d).withColumn("v", v), 1, 2, 2, 255)


@query(f"""with {views.PXN} select raster_id, count(*) as n, count(v) filter ({OK}) as n_valid, min(v) filter ({OK}) as lo, max(v) filter ({OK}) as hi,
round(avg(v) filter ({OK}), 6) as mean, round(stddev_pop(v) filter ({OK}), 6) as std, round(coalesce(median(v) filter ({OK}), 0), 6) as median,
round(quantile_cont(v, 0.02) filter ({OK}), 6) as p02, round(quantile_cont(v, 0.98) filter ({OK}), 6) as p98 from pxn group by raster_id""")
def valid_stats(spark, d):
    s = raster.stats(views.px(spark, d, True), raster.valid("v"))
    s = s.withColumn("p02", F.col("p")[0]).withColumn("p98", F.col("p")[1]).drop("p")
    return _round(s, "mean", "std", "median", "p02", "p98")


@query(f"with {views.PXN}, s as (select raster_id, avg(v) as m, stddev_pop(v) as s from pxn group by raster_id) select raster_id, y, x, round(case when s = 0 then 0 else (v - m) / s end, 6) as z from pxn join s using (raster_id)")
def zscore_elev(spark, d):
    return _round(raster.zscore(views.px(spark, d, True)), "z")


@query(f"""with {views.PXN}, p as (select raster_id, quantile_cont(v, 0.02) filter ({OK}) as lo, quantile_cont(v, 0.98) filter ({OK}) as hi from pxn group by raster_id)
select raster_id, y, x, round(case when {OK} then greatest(0, least(1, (v - lo) / (case when hi <= lo then lo + 1e-6 else hi end - lo))) else 0 end, 6) as v_01 from pxn join p using (raster_id)""")
def stretch01(spark, d):
    px = views.px(spark, d, True).withColumn("ok", raster.valid("v"))
    return _round(raster.stretch(px, "v", "ok").select("raster_id", "y", "x", "v_01"), "v_01")


@query(f"with {views.PX}, src as (select *, v as f from px), {views.GRADIENTS} select raster_id, y, x, round(dx, 6) as dx, round(dy, 6) as dy from grad")
def sobel(spark, d):
    return _round(raster.gradients(views.px(spark, d)).select("raster_id", "y", "x", "dx", "dy"), "dx", "dy")


@query(f"with {views.PX}, src as (select *, v as f from px), {views.GRADIENTS} select raster_id, y, x, round(curv, 6) as curv from grad")
def laplacian(spark, d):
    return _round(raster.gradients(views.px(spark, d)).select("raster_id", "y", "x", "curv"), "curv")


_STRETCHED = ", ".join(f"round(case when ok then greatest(0, least(1, ({c} - lo{k}) / (case when hi{k} <= lo{k} then lo{k} + 1e-6 else hi{k} end - lo{k}))) else 0 end, 6) as b{k}" for k, c in enumerate(("dx", "dy", "curv"), 1))
_RANGES = ", ".join(f"quantile_cont({c}, 0.02) filter (ok) as lo{k}, quantile_cont({c}, 0.98) filter (ok) as hi{k}" for k, c in enumerate(("dx", "dy", "curv"), 1))


@query(f"""with {views.PXN}, m as (select *, {OK} as ok from pxn), fill as (select raster_id, coalesce(median(v) filter (ok), 0) as fill from m group by raster_id),
src as (select raster_id, y, x, ok, case when ok then v else fill end as f from m join fill using (raster_id)), {views.GRADIENTS},
p as (select raster_id, {_RANGES} from grad group by raster_id) select raster_id, y, x, {_STRETCHED} from grad join p using (raster_id)""")
def topo_composite(spark, d):
    return _round(raster.topo_composite(views.px(spark, d, True)), "b1", "b2", "b3")


_SHADE = "cos(radians(45.0)) * cos(slope) + sin(radians(45.0)) * sin(slope) * cos(radians(135.0) - aspect)"


@query(f"""with {views.PXN}, src as (select *, v as f from pxn), {views.GRADIENTS},
s as (select *, atan(sqrt(dx * dx / 6400 + dy * dy / 6400)) as slope, atan2(dy / 80, -dx / 80) as a from grad),
t as (select *, case when a < 0 then a + 2 * pi() else a end as aspect from s)
select raster_id, y, x, round(case when v <> -9999 and not isnan(v) then greatest(0, least(1, {_SHADE})) else 0 end, 5) as shade from t""")
def hillshade(spark, d):
    return _round(raster.hillshade(views.px(spark, d, True), 10).select("raster_id", "y", "x", "shade"), "shade", n=5)


@query(f"""with {views.PX}, src as (select *, v as f from px), {views.GRADIENTS},
b as (select *, max(x) over (partition by raster_id, y) as mx, max(y) over (partition by raster_id, x) as my from grad),
t as (select *, (x > 0 and y > 0 and x < mx and y < my) as inside, -dx / 800 as gx, dy / 800 as gy from b),
u as (select *, case when inside then degrees(atan(sqrt(gx * gx + gy * gy))) else -9999 end as slope,
  (sin(radians(45.0)) - cos(radians(45.0)) * sqrt(gx * gx + gy * gy) * sin(atan2(gy, gx) - radians(315.0))) / sqrt(1 + gx * gx + gy * gy) as cang from t),
s as (select raster_id, avg(v) as m, stddev_pop(v) as dev, min(slope) as lo, max(slope) as hi from u group by raster_id)
select raster_id, y, x, round(case when dev = 0 then 0 else (v - m) / dev end, 6) as b1, round(case when hi = lo then 0 else (slope - lo) / (hi - lo) end, 6) as b2,
  round(case when inside then case when cang <= 0 then 1 else 1 + 254 * cang end else 0 end / 255, 6) as b3 from u join s using (raster_id)""")
def terrain_stack(spark, d):
    return _round(raster.terrain_stack(views.px(spark, d), 100), "b1", "b2", "b3")


@query(f"with {views.PX}, src as (select *, v as f from px), {views.GRADIENTS} select raster_id, y, x, round(degrees(atan(sqrt(dx * dx + dy * dy) / 800)), 6) as slope from grad")
def slope(spark, d):
    return raster.slope(views.px(spark, d), 100).withColumn("slope", F.round("slope", 6))


def _square(f: str, r: int, src: str, out: str) -> str:
    return f"""{out}h as (select raster_id, y, x, {f}(m) over (partition by raster_id, y order by x range between {r} preceding and {r} following) as m from {src}),
{out} as (select raster_id, y, x, {f}(m) over (partition by raster_id, x order by y range between {r} preceding and {r} following) as m from {out}h)"""


def _mask(spark, d):
    return views.px(spark, d).select("raster_id", "y", "x", (F.col("v") > -60).cast("int").alias("m"))


_MASK = f"with {views.PX}, mask as (select raster_id, y, x, cast(v > -60 as integer) as m from px)"


@query(f"{_MASK}, {_square('min', 1, 'mask', 'e')} select * from e")
def erode3(spark, d):
    return raster.erode3(_mask(spark, d), "m")


@query(f"{_MASK}, {_square('max', 2, 'mask', 'a')}, {_square('min', 2, 'a', 'b')} select * from b")
def close5(spark, d):
    return raster.close5(_mask(spark, d), "m")


@query(f"""with {views.PX}, mask as (select raster_id, y, x, cast(v > 200 as integer) as m from px),
hits as (select distinct raster_id, y + dy as y, x + dx as x from mask, (values (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) as n(dy, dx) where m > 0)
select m.raster_id, m.y, m.x, case when h.y is null then 0 else 1 end as m from mask m left join hits h on m.raster_id = h.raster_id and m.y = h.y and m.x = h.x""")
def widen(spark, d):
    mask = views.px(spark, d).select("raster_id", "y", "x", (F.col("v") > 200).cast("int").alias("m"))
    return raster.widen(mask, "m", 2.5)


@query(f"""with {views.PX}, n as (select raster_id, y, x, case when x >= 32 and y < 16 then -9999.0 else v end as v from px)
select raster_id, cast(y // 16 as bigint) as ty, cast(x // 16 as bigint) as tx, count(*) as n from n group by raster_id, y // 16, x // 16 having not bool_and(abs(v + 9999) <= 1e-8)""")
def skip_nodata_tiles(spark, d):
    v = F.when((F.col("x") >= 32) & (F.col("y") < 16), F.lit(-9999.0)).otherwise(F.col("v"))
    return raster.skip_nodata_tiles(views.px(spark, d).withColumn("v", v), 16)


@query(f"""with {views.PX}, s as (select raster_id, max(y) + 1 as h, max(x) + 1 as w from px group by raster_id),
g as (select *, unnest(range(0, cast(ceil(h / 2.5) as bigint))) as oy from s), k as (select *, unnest(range(0, cast(ceil(w / 2.5) as bigint))) as ox from g),
c as (select *, greatest(0, least((oy + 0.5) * 2.5 - 0.5, h - 1.0)) as sy, greatest(0, least((ox + 0.5) * 2.5 - 0.5, w - 1.0)) as sx from k),
t as (select c.*, dy, dx, case dy when 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end * case dx when 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end as wt,
  least(floor(sy) + dy, h - 1) as y, least(floor(sx) + dx, w - 1) as x from c, (values (0, 0), (0, 1), (1, 0), (1, 1)) as n(dy, dx))
select t.raster_id, cast(oy as integer) as y, cast(ox as integer) as x, round(sum(wt * v), 6) as v from t join px p on t.raster_id = p.raster_id and t.y = p.y and t.x = p.x group by t.raster_id, oy, ox""")
def resample_bilinear(spark, d):
    return _round(raster.resample_bilinear(views.px(spark, d), 2.5), "v")


@query(f"""with {views.PX} select g.raster_id, g.y, g.x, coalesce(p.v, 0.0) as v from px g left join px p on p.raster_id = g.raster_id and p.y = floor((g.y + 0.5) * 1.5) and p.x = floor((g.x + 0.5) * 1.5)""")
def nn_regrid(spark, d):
    px = views.px(spark, d)
    return raster.regrid_nearest(px, px.select("raster_id", "y", "x"), 1.5)


@query("select cast(floor(event_id / 500.0) as bigint) as y, cast(floor(user_id / 25.0) as bigint) as x, max(value) as z, count(*) as n from events group by 1, 2")
def point_grid_max(spark, d):
    return raster.points_to_grid(views.table(spark, d, "events").select(F.col("user_id").alias("px"), F.col("event_id").alias("py"), F.col("value").alias("z")).withColumn("px", F.col("px") * 20), 500.0)


@query("""with c as (select cast(floor(event_id / 500.0) as bigint) as y, cast(floor(user_id / 25.0) as bigint) as x, max(value) as z from events group by 1, 2),
n as (select max(y) + 1 as h, max(x) + 1 as w from c), g as (select i // w as y, i % w as x from (select w, unnest(range(0, h * w)) as i from n)) select g.y, g.x, coalesce(c.z, -9999.0) as z from g left join c on g.y = c.y and g.x = c.x""")
def point_grid_fill(spark, d):
    cells = point_grid_max(spark, d).select("y", "x", "z")
    size = cells.agg(F.max("y") + 1, F.max("x") + 1).first()  # the template covers all points
    return raster.fill_grid(cells, *size)


_COLOR = color.sql_elevation("v", "lo", "hi", "linsar")


@query(f"""with {views.PXN}, s as (select raster_id, min(v) filter (v <> -9999) as lo, max(v) filter (v <> -9999) as hi from pxn group by raster_id)
select raster_id, y, x, round({_COLOR[0]}, 6) as r, round({_COLOR[1]}, 6) as g, round({_COLOR[2]}, 6) as b from pxn join s using (raster_id)""")
def color_ramp(spark, d):
    px = views.px(spark, d, True)
    s = px.groupBy("raster_id").agg(F.min(F.when(F.col("v") != -9999, F.col("v"))).alias("lo"), F.max(F.when(F.col("v") != -9999, F.col("v"))).alias("hi"))
    rgb = color.elevation_color(F.col("v"), F.col("v") != -9999, F.col("lo"), F.col("hi"), "linsar")
    return px.join(s, "raster_id").select("raster_id", "y", "x", *[F.round(c, 6).alias(n) for c, n in zip(rgb, "rgb")])


@query(f"with {views.PX}, c as (select raster_id, y, x, (v + 600) / 1200 as r, 0.5 as g, (x + 0.5) / 64 as b, (y % 10) / 9.0 as shade from px) select raster_id, y, x, {color.sql_blend('r', 'g', 'b', 'shade', 1.5)} from c")
def shaded_rgb(spark, d):
    px = views.px(spark, d).select("raster_id", "y", "x", ((F.col("v") + 600) / 1200).alias("r"), F.lit(0.5).alias("g"), ((F.col("x") + 0.5) / 64).alias("b"), ((F.col("y") % 10) / F.lit(9.0)).alias("shade"))
    out = color.blended(px, ("r", "g", "b"), "shade", 1.5)
    return out.select("raster_id", "y", "x", *[F.round(c, 4).alias(f"out_{c}") for c in "rgb"])


@query("""with s as (select p_partkey, 1500 + p_size * 40 as w, 900 + p_size * 25 as h from part),
x as (select *, cast(ceil((w - 24) / 1000.0) as bigint) as nx, cast(ceil((h - 24) / 1000.0) as bigint) as ny from s),
t as (select *, unnest(range(0, nx)) as tx from x), u as (select *, unnest(range(0, ny)) as ty from t)
select p_partkey, tx, ty, case when tx = nx - 1 then greatest(0, w - 1024) else tx * 1000 end as x_off, case when ty = ny - 1 then greatest(0, h - 1024) else ty * 1000 end as y_off,
 round(500000.0 + 2.0 * case when tx = nx - 1 then greatest(0, w - 1024) else tx * 1000 end, 6) as gx from u""")
def tile_grid(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", (1500 + F.col("p_size") * 40).alias("w"), (900 + F.col("p_size") * 25).alias("h"))
    t = p.select("p_partkey", F.posexplode(grid.tile_offsets(F.col("w"), 1024, 24)).alias("tx", "x_off"), "h")
    t = t.select("p_partkey", "tx", "x_off", F.posexplode(grid.tile_offsets(F.col("h"), 1024, 24)).alias("ty", "y_off"))
    gt = F.array(*[F.lit(v) for v in (500000.0, 2.0, 0.0, 4000000.0, 0.0, -2.0)])
    return t.select("p_partkey", "tx", "ty", "x_off", "y_off", F.round(grid.tile_transform(gt, F.col("x_off"), F.col("y_off"))[0], 6).alias("gx"))


@query("""with s as (select p_partkey, 700 + p_size * 60 as w from part)
select distinct p_partkey, unnest(case when w <= 1024 then [0] else list_concat(range(0, w - 1024 + 1, 700), [w - 1024]) end)::integer as start from s""")
def window_starts(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", (700 + F.col("p_size") * 60).alias("w"))
    return p.select("p_partkey", F.explode(grid.window_starts(F.col("w"), 1024, 700)).alias("start"))


_GT = "1000.0 + c_custkey", "0.5", "0.125", "9000.0", "-0.25", "-2.0"


@query(f"""with s as (select c_custkey, cast(c_nationkey as double) as px, c_acctbal as py from customer)
select c_custkey, round({_GT[0]} + px * 0.5 + py * 0.125, 6) as gx, round(9000.0 - px * 0.25 - py * 2.0, 6) as gy, round(px, 6) as bx, round(py, 6) as by from s""")
def pixel_geo_round_trip(spark, d):
    c = views.table(spark, d, "customer")
    gt = F.array(F.lit(1000.0) + F.col("c_custkey"), *[F.lit(v) for v in (0.5, 0.125, 9000.0, -0.25, -2.0)])
    c = c.withColumn("g", grid.pixel_to_geo(gt, F.col("c_nationkey").cast("double"), F.col("c_acctbal")))
    c = c.withColumn("p", grid.geo_to_pixel(gt, F.col("g.gx"), F.col("g.gy")))
    return c.select("c_custkey", F.round("g.gx", 6).alias("gx"), F.round("g.gy", 6).alias("gy"), F.round("p.x", 6).alias("bx"), F.round("p.y", 6).alias("by"))


@query("select c_custkey, case when floor((lon + 180) / 6) + 1 between 1 and 60 then cast(floor((lon + 180) / 6) + 1 + 26900 as bigint) end as epsg from (select c_custkey, c_acctbal / 25 as lon from customer)")
def utm_zone(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", grid.utm_epsg(F.col("c_acctbal") / 25).alias("epsg"))


_MY = "ln(tan(pi() / 4 + radians({0}) / 2)) * 6378137.0"


@query(f"""with s as (select s_suppkey, s_acctbal / 60 as lon, s_nationkey * 2.5 - 30 as lat from supplier)
select s_suppkey, round(radians(lon) * 6378137.0, 3) as mxmin, round({_MY.format('lat')}, 3) as mymin, round(radians(lon + 1.5) * 6378137.0, 3) as mxmax, round({_MY.format('(lat + 1)')}, 3) as mymax from s""")
def bbox_3857(spark, d):
    s = views.table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 60).alias("lon"), (F.col("s_nationkey") * 2.5 - 30).alias("lat"))
    s = s.select("s_suppkey", grid.bbox_mercator(F.col("lon"), F.col("lat"), F.col("lon") + 1.5, F.col("lat") + 1).alias("b"))
    return s.select("s_suppkey", *[F.round(F.col(f"b.{c}"), 3).alias(c) for c in ("mxmin", "mymin", "mxmax", "mymax")])


_WKT = """case n_nationkey % 3 when 0 then 'PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","' || (32600 + n_nationkey) || '"]]' when 1 then 'PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4269"]]] ' else 'LOCAL["z"]' end"""


@query(f"""with w as (select n_nationkey, {_WKT} as wkt from nation) select n_nationkey, cast(case when regexp_matches(wkt, 'AUTHORITY\\["EPSG","(\\d+)"\\]\\]$') then regexp_extract(wkt, 'AUTHORITY\\["EPSG","(\\d+)"\\]\\]$', 1)
 else nullif(regexp_extract(wkt, '.*AUTHORITY\\["EPSG","(\\d+)"\\]', 1), '') end as integer) as epsg from w""")
def epsg_from_wkt(spark, d):
    n = views.table(spark, d, "nation").withColumn("wkt", F.expr(_WKT))
    return n.select("n_nationkey", grid.epsg_of_wkt(F.col("wkt")).alias("epsg"))


@query("select p_partkey, least(100.0::double, 100.0 + w * rx) as xmin, least(50.0::double, 50.0 + h * ry) as ymin, greatest(100.0::double, 100.0 + w * rx) as xmax, greatest(50.0::double, 50.0 + h * ry) as ymax, abs(rx) as xres, abs(ry) as yres from (select p_partkey, p_size * 10 as w, p_size * 7 as h, (case when p_partkey % 2 = 0 then 0.5 else -0.5 end)::double as rx, (-0.25)::double as ry from part)")
def raster_info(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("w"), (F.col("p_size") * 7).alias("h"), F.when(F.col("p_partkey") % 2 == 0, 0.5).otherwise(-0.5).alias("rx"))
    gt = F.array(F.lit(100.0), F.col("rx"), F.lit(0.0), F.lit(50.0), F.lit(0.0), F.lit(-0.25))
    return p.select("p_partkey", grid.raster_info(gt, F.col("w"), F.col("h")).alias("i")).select("p_partkey", "i.*")


@query(f"with {views.PX} select raster_id, cast(floor(v / 100) * 100 as bigint) as bin, count(*) as n, round(avg(v), 6) as mean from px group by raster_id, floor(v / 100)")
def class_hist(spark, d):
    return raster.class_histogram(views.px(spark, d), F.floor(F.col("v") / 100) * 100, F.col("v")).withColumn("mean", F.round("mean", 6))
