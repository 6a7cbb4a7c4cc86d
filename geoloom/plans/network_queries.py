"""Queries of the line-network, vector and detection-suppression operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import network, vector
from geoloom.plans import views
from geoloom.plans.registry import query

_PRUNE = """deg as (select node, count(distinct fid) as deg from (select fid, u as node from {src} union all select fid, v from {src}) group by node),
{out} as (select e.*, s.deg - 1 as s_deg, t.deg - 1 as e_deg,
  case when s.deg > 1 and t.deg > 1 then 'NORMAL_KEEP' when s.deg = 1 and t.deg = 1 then case when len <= {n} then 'SHORT_ISOLATED' else 'LONG_ISO_KEEP' end
       when len <= {n} then 'SHORT_DANGLE' else 'LONG_DANGLE_KEEP' end as code
  from {src} e join deg s on s.node = e.u join deg t on t.node = e.v)"""
_PRUNED = _PRUNE.format(src="edges", out="pruned", n=150000)


@query(f"with {views.EDGES}, {_PRUNED} select fid, u, v, len, s_deg, e_deg, code, case when code like 'SHORT%' then 1 else 0 end as removed from pruned")
def dangle_prune(spark, d):
    return network.dangle_prune(views.edges(spark, d), 150000, 150000)


@query(f"with {views.EDGES}, {_PRUNED} select code, count(*) as n, round(sum(len), 2) as total_len from pruned group by code")
def dangle_prune_report(spark, d):
    out = network.dangle_prune(views.edges(spark, d), 150000, 150000)
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("len"), 2).alias("total_len"))


def _bridges(src: str, p: str, rounds: int = 60) -> str:
    """CTEs that end in {p}bridge (fid): a breadth-first forest, and the tree edges that no other edge spans.

    Labels and distances go along all edges ``rounds`` times, which must be no less than the network's diameter.
    """
    return f"""{p}real as (select fid, u, v from {src} where u <> v), {p}adj as (select u as x, v as y, fid from {p}real union all select v, u, fid from {p}real),
{p}near as (select distinct x, y from {p}adj union select x, x from {p}adj),
{p}lab as (select 0 as k, x as node, min(x) as label from {p}near group by x union all select l.k + 1, n.x, min(l.label) from {p}lab l join {p}near n on n.y = l.node where l.k < {rounds} group by l.k + 1, n.x),
{p}root as (select distinct label as node from {p}lab where k = {rounds}),
{p}walk as (select node, 0 as dist from {p}root union select n.y, w.dist + 1 from {p}walk w join {p}near n on n.x = w.node where w.dist < {rounds}),
{p}level as (select node, min(dist) as dist from {p}walk group by node),
{p}parent as (select c.node, min(a.fid) as fid, arg_min(a.y, a.fid) as up from {p}level c join {p}adj a on a.x = c.node join {p}level b on b.node = a.y and b.dist = c.dist - 1 group by c.node),
{p}above as (select node, node as anc from {p}level union all select s.node, t.up from {p}above s join {p}parent t on t.node = s.anc),
{p}loose as (select fid, u as node from {p}real where fid not in (select fid from {p}parent) union all select fid, v from {p}real where fid not in (select fid from {p}parent)),
{p}once as (select s.anc, l.fid from {p}loose l join {p}above s on s.node = l.node group by s.anc, l.fid having count(*) = 1),
{p}bridge as (select fid from {p}parent where node not in (select anc from {p}once))"""


def _purged(src: str, p: str) -> str:
    return f"""{_bridges(src, p)}, {p}purged as (select e.*, case when e.u = e.v then 'SELF_LOOP' when b.fid is not null then 'BRIDGE_KEEP' else 'CYCLE_EDGE' end as code from {src} e left join {p}bridge b on b.fid = e.fid)"""


@query(f"with recursive {views.EDGES}, {_bridges('edges', 'a_')} select fid from a_bridge")
def bridges(spark, d):
    return network.bridges(views.edges(spark, d))


@query(f"with recursive {views.EDGES}, {_purged('edges', 'a_')} select fid, u, v, len, code, case when code = 'BRIDGE_KEEP' then 0 else 1 end as removed from a_purged")
def loop_purge(spark, d):
    return network.loop_purge(views.edges(spark, d))


_FIRST = _PRUNE.format(src="edges", out="one", n=100000)
_LAST = _PRUNE.replace("deg as", "deg2 as").replace("join deg ", "join deg2 ").format(src="looped", out="three", n=100000)


@query(f"""with recursive {views.EDGES}, {_FIRST}, dangled as (select fid, u, v, len from one where code not like 'SHORT%'), {_purged('dangled', 'b_')},
looped as (select fid, u, v, len from b_purged where code = 'BRIDGE_KEEP'), {_LAST} select fid, u, v, len from three where code not like 'SHORT%'""")
def cleanup_chain(spark, d):
    return network.cleanup(views.edges(spark, d), 100000)


_CONFLICTS = """area as (select *, 1600.0 as a from boxes), pairs as (
  select p.det as a, q.det as b from area p join area q on p.cls = q.cls and p.det <> q.det
   and greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1))
     > 0.5 * (3200.0 - greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1))))"""


@query(f"""with recursive {views.BOXES}, {_CONFLICTS}, ordered as (select det, cls, row_number() over (partition by cls order by conf desc, det) as r from boxes),
near as (select o.det, o.cls, o.r, coalesce(list(p.b) filter (p.b is not null), []) as bs from ordered o left join pairs p on p.a = o.det group by o.det, o.cls, o.r),
walk as (select cls, r, case when true then [det] end as kept, det, true as keep from near where r = 1
  union all select n.cls, n.r, case when list_has_any(n.bs, w.kept) then w.kept else list_append(w.kept, n.det) end, n.det, not list_has_any(n.bs, w.kept) from walk w join near n on n.cls = w.cls and n.r = w.r + 1)
select det, cls from walk where keep""")
def nms_class_aware(spark, d):
    return vector.nms(views.boxes(spark, d), 0.5).select("det", "cls")


@query(f"""with recursive {views.BOXES}, pairs as (select p.det as a, q.det as b from boxes p join boxes q on p.cls = q.cls and p.det <> q.det and abs(p.x1 - q.x1) <= 6 and abs(p.y1 - q.y1) <= 6),
ordered as (select det, cls, row_number() over (partition by cls order by det) as r from boxes),
near as (select o.det, o.cls, o.r, coalesce(list(p.b) filter (p.b is not null), []) as bs from ordered o left join pairs p on p.a = o.det group by o.det, o.cls, o.r),
walk as (select cls, r, [det] as kept, det, true as keep from near where r = 1
  union all select n.cls, n.r, case when list_has_any(n.bs, w.kept) then w.kept else list_append(w.kept, n.det) end, n.det, not list_has_any(n.bs, w.kept) from walk w join near n on n.cls = w.cls and n.r = w.r + 1),
kept as (select det, cls from walk where keep),
base as (select n.det, coalesce((select min(k.det) from kept k where k.det = n.det), (select min(k.det) from kept k where list_contains(n.bs, k.det))) as base from near n)
select base, count(*) as members, min(det) as fid from base group by base""")
def dissolve_greedy(spark, d):
    lines = views.boxes(spark, d).select(F.col("det").alias("id"), F.col("det").alias("rank"), "cls", "x1", "y1")
    cell = lines.select("*", F.floor(F.col("x1") / 6).alias("cx"), F.floor(F.col("y1") / 6).alias("cy"))
    spread = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = cell.select(F.col("id").alias("b"), "cls", F.col("x1").alias("bx"), F.col("y1").alias("by"), "cx", "cy", F.explode(spread).alias("s"))
    other = other.select("b", "cls", "bx", "by", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    pairs = cell.join(other, ["cls", "cx", "cy"]).filter("id < b and abs(x1 - bx) <= 6 and abs(y1 - by) <= 6").select(F.col("id").alias("a"), "b")
    out = network.independent_set(lines.select("id", "rank"), pairs)
    return out.groupBy("base").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("fid"))


@query("""with s as (select vec_id, list_transform(embedding[1:16], lambda e: cast(e as double) * 100) as c from embeddings),
seg as (select vec_id, unnest(range(0, 7)) as k, c from s)
select vec_id, round(sum(sqrt(pow(c[2 * k + 3] - c[2 * k + 1], 2) + pow(c[2 * k + 4] - c[2 * k + 2], 2))) * 2.0, 6) as len_m from seg group by vec_id""")
def line_length(spark, d):
    e = views.table(spark, d, "embeddings")
    c = F.transform(F.slice("embedding", 1, 16), lambda v: v.cast("double") * 100)
    points = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(F.element_at(c, 2 * k + 1).alias("x"), F.element_at(c, 2 * k + 2).alias("y")))
    return e.select("vec_id", F.round(vector.line_length(points, 2.0), 6).alias("len_m"))


@query("select fid, grid_code, u, v from (select o_orderkey as fid, o_orderkey % 3 as grid_code, o_custkey as u, o_custkey + 1 as v, case when o_orderkey % 11 = 0 then null else 'g' end as geom from orders) where geom is not null")
def field_prune(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("fid"), (F.col("o_orderkey") % 3).alias("grid_code"), F.col("o_custkey").alias("u"), (F.col("o_custkey") + 1).alias("v"),
        F.col("o_totalprice").alias("LP_LEN"), F.lit(1).alias("len_m_2"), F.lit("x").alias("rm_code"), F.lit(0).alias("Loop_rm"), F.when(F.col("o_orderkey") % 11 != 0, "g").alias("geom"))
    return vector.prune_fields(o, "geom", ["fid", "grid_code", "u", "v", "LP_LEN"])


@query("""with c as (select o_orderkey as fid, case o_orderkey % 6 when 0 then '255' when 1 then '128' when 2 then '255.7' when 3 then '7' when 4 then 'x' end as raw from orders)
select fid, case cast(trunc(try_cast(raw as double)) as integer) when 255 then 0 else 1 end as cls from c where cast(trunc(try_cast(raw as double)) as integer) in (255, 128)""")
def class_decode(spark, d):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "255").when(k == 1, "128").when(k == 2, "255.7").when(k == 3, "7").when(k == 4, "x")
    return vector.decode_classes(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("fid"), raw.alias("raw")), "raw").select("fid", "cls")


@query("""with f as (select s_suppkey as file, case when s_suppkey % 7 = 3 then ['id:int', 'name:text'] when s_suppkey % 7 = 5 then ['name:text', 'id:int', 'z:real'] else ['id:int', 'name:text', 'z:real'] end as fields from supplier),
r as (select fields from f order by file limit 1) select file, f.fields = r.fields as same, len(list_filter(r.fields, lambda x: not list_contains(f.fields, x)))::integer as n_missing from f, r""")
def schema_consensus(spark, d):
    s = views.table(spark, d, "supplier")
    full = [("id", "int"), ("name", "text"), ("z", "real")]
    kind = F.col("s_suppkey") % 7

    def fields(rows):
        return F.array(*[F.lit(f"{a}:{b}") for a, b in rows])

    s = s.select(F.col("s_suppkey").alias("file"), F.when(kind == 3, fields(full[:2])).when(kind == 5, fields([full[1], full[0], full[2]])).otherwise(fields(full)).alias("fields"))
    return vector.schema_consensus(s)


_TILE = "cast(floor(x1 / 25.0) as bigint)", "cast(floor(x2 / 25.0) as bigint)"


@query(f"""with {views.BOXES}, t as (select i % 12 - 4 as tx, i // 12 - 4 as ty from (select unnest(range(0, 144)) as i)), tiles as (select tx, ty, tx * 25.0 as x1, ty * 25.0 as y1, tx * 25.0 + 25 as x2, ty * 25.0 + 25 as y2 from t)
select tx, ty, det from tiles t join boxes b on t.x1 <= b.x2 and b.x1 <= t.x2 and t.y1 <= b.y2 and b.y1 <= t.y2""")
def bbox_tile_join(spark, d):
    t = spark.range(144).select((F.col("id") % 12 - 4).alias("tx"), (F.floor(F.col("id") / 12) - 4).alias("ty"))
    tiles = t.select("tx", "ty", (F.col("tx") * 25.0).alias("x1"), (F.col("ty") * 25.0).alias("y1"), (F.col("tx") * 25.0 + 25).alias("x2"), (F.col("ty") * 25.0 + 25).alias("y2"))
    return vector.bbox_join(tiles, views.boxes(spark, d), 50.0).select("tx", "ty", "det")


@query("""with a as (select s_suppkey, s_acctbal / 60 as x1, s_nationkey as y1, s_acctbal / 60 + 0.5 as x2, s_nationkey + 0.5 as y2 from supplier),
b as (select c_custkey, c_acctbal / 60 as x1, c_nationkey as y1, c_acctbal / 60 + 0.5 as x2, c_nationkey + 0.5 as y2 from customer)
select s_suppkey, c_custkey from a join b on a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2""")
def bbox_intersects(spark, d):
    def box(name, key, bal, nation):
        x, y = F.col(bal) / 60, F.col(nation)
        return views.table(spark, d, name).select(key, x.alias("x1"), y.cast("double").alias("y1"), (x + 0.5).alias("x2"), (y + 0.5).alias("y2"))

    return vector.bbox_join(box("supplier", "s_suppkey", "s_acctbal", "s_nationkey"), box("customer", "c_custkey", "c_acctbal", "c_nationkey"), 1.0).select("s_suppkey", "c_custkey")


@query("with p as (select event_id % 50 as prefix, json_extract_string(props, '$.k')::double as k from events) select prefix, min(k) as xmin, max(k) as xmax, max(k) >= 50 as hit from p group by prefix")
def ept_match(spark, d):
    e = views.table(spark, d, "events").select((F.col("event_id") % 50).alias("prefix"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    e = e.groupBy("prefix").agg(F.min("k").alias("xmin"), F.max("k").alias("xmax"))
    e = e.withColumn("json", F.when(F.col("prefix") % 2 == 0, F.to_json(F.struct(F.array("xmin", F.lit(0.0), F.lit(0.0), "xmax", F.lit(1.0), F.lit(1.0)).alias("bounds")))).otherwise(F.to_json(F.struct(F.array("xmin", F.lit(0.0), F.lit(0.0), "xmax", F.lit(1.0), F.lit(1.0)).alias("boundsConforming"), F.array(F.lit(9.0)).alias("bounds")))))
    b = vector.ept_bounds(F.col("json"))
    return e.select("prefix", b["xmin"].alias("xmin"), b["xmax"].alias("xmax"), (b["xmax"] >= 50).alias("hit"))
