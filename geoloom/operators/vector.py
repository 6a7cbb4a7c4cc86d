"""Vector-layer, box and detection operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.grid import bbox_meets
from geoloom.operators.network import greedy_set
from geoloom.session import free, stored

# Names of diagnostic fields of earlier passes, matched without case.
DIAGNOSTIC_PREFIXES = ("lp_", "loop_")
DIAGNOSTIC_PATTERNS = (r"len_m(_\d+)?", r"rm_code(_\d+)?")
# Diagnostic fields that a second pass over dangling lines leaves out, without case.
PASS_FIELDS = (
    "len_m", "len_m_1", "s_deg", "e_deg", "rm_flag", "rm_code", "rm_code_1", "loop_rm",
    "LP_LEN", "LP_SDEG", "LP_EDEG", "LP_RM", "LP_CODE", "LOOP_LEN", "LOOP_RM", "LOOP_CODE",
)


def is_diagnostic(name: str, exact: tuple[str, ...] = ("loop_rm",)) -> bool:
    n = name.lower()
    return n in exact or n.startswith(DIAGNOSTIC_PREFIXES) or any(re.fullmatch(p, n) for p in DIAGNOSTIC_PATTERNS)


def prune_fields(layer: DataFrame, geometry: str, keep: list[str] | None = None) -> DataFrame:
    """Drops diagnostic fields, then all but ``keep`` (case counts; it brings no diagnostic field back), and rows without geometry."""
    names = [c for c in layer.columns if c != geometry and not is_diagnostic(c) and (keep is None or c in keep)]
    return layer.filter(F.col(geometry).isNotNull()).select(*names)


def skip_pass_fields(layer: DataFrame) -> DataFrame:
    """Drops the diagnostic fields of an earlier pass: just those names, no prefixes or patterns."""
    known = {n.lower() for n in PASS_FIELDS}
    return layer.drop(*[c for c in layer.columns if c.lower() in known])


def decode_classes(layer: DataFrame, field: str, classes: dict[int, int] | None = None) -> DataFrame:
    """Adds cls: 255 is 0, 128 is 1 (decimals are cut off); rows of other or unreadable values go."""
    value = F.col(field).try_cast("double")
    code = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("int")
    cls = None
    for raw, k in (classes or {255: 0, 128: 1}).items():
        cls = F.when(code == raw, F.lit(k)) if cls is None else cls.when(code == raw, F.lit(k))
    return layer.withColumn("cls", cls).filter("cls is not null")


def line_length(points: Column, factor: float = 1.0) -> Column:
    """Length of a line given as an array of (x, y), times a factor; null or single points have 0."""
    n = F.coalesce(F.size(points), F.lit(0))
    steps = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) * factor)


def affine_points(points: Column, gt: Column) -> Column:
    """Points in the pixel space of a transform without rotation."""
    return F.transform(points, lambda p: F.struct(((p["x"] - gt[0]) / gt[1]).alias("x"), ((p["y"] - gt[3]) / gt[5]).alias("y")))


def schema_consensus(files: DataFrame) -> DataFrame:
    """file, same (its ordered fields are those of the smallest file name), n_missing."""
    first = files.agg(F.min_by("fields", "file").alias("wanted")).withColumn("__k", F.lit(0))  # one row
    both = files.withColumn("__k", F.lit(0)).join(F.broadcast(first), "__k")
    return both.select("file", (F.col("fields") == F.col("wanted")).alias("same"), F.size(F.array_except("wanted", "fields")).alias("n_missing"))


#: A box takes cells of the finest of these sizes (in times the cell) that is no smaller than a LEVEL_STEP-th of it.
LEVEL_STEP, LEVELS = 8, 12
#: Rows of a side that meet in one task; a fuller cell is dealt into blocks of about so many rows of either side.
BLOCK = 2000


def _own_level(cell: float) -> Column:
    edge = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log(F.greatest(edge / (cell * LEVEL_STEP), F.lit(1.0))) / F.log(F.lit(float(LEVEL_STEP))) - 1e-9))).cast("int")


def _own_levels(df: DataFrame, cell: float) -> list[int]:
    """The levels that boxes have, LEVELS at most."""
    return sorted(df.agg(F.collect_set(_own_level(cell))).first()[0])


def _meetings(mine: list[int], others: list[int], left: bool) -> Column:
    """Where a box of level __own is laid out: (level, way), only where the other side has boxes to meet.

    Two boxes meet at the level of the larger one: by way 0 if the right one is of that
    level, by way 1 if the left one alone is. So small boxes never meet at a coarse level.
    """
    out = F.array().cast("array<struct<level:int,way:int>>")
    for o in mine:
        coarser = [x for x in others if x > o]
        if left:
            found = [(o, 0)] * (o in others) + [(o, 1)] * any(x < o for x in others) + [(x, 0) for x in coarser]
        else:
            found = [(o, 0)] * any(x <= o for x in others) + [(x, 1) for x in coarser]
        if found:
            out = F.when(F.col("__own") == o, F.array(*[F.struct(F.lit(x).alias("level"), F.lit(k).alias("way")) for x, k in found])).otherwise(out)
    return out


def _cells(df: DataFrame, cell: float, meetings: Column | None = None) -> DataFrame:
    """df with the grid cells (__level, __way, __cx, __cy) that each box meets; by default at all levels from its own.

    A box of any size takes at most (LEVEL_STEP + 2) ** 2 cells of its own level, and
    a few of each coarser one.
    """
    if meetings is None:
        meetings = F.transform(F.sequence(F.col("__own"), F.lit(LEVELS - 1)), lambda x: F.struct(x.alias("level"), F.lit(0).alias("way")))
    out = df.withColumn("__own", _own_level(cell)).withColumn("__m", F.explode(meetings))
    out = out.withColumn("__level", F.col("__m.level")).withColumn("__way", F.col("__m.way")).drop("__own", "__m")
    size = _level_size(cell)
    spans = [F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)) for a, b in (("x1", "x2"), ("y1", "y2"))]
    return out.withColumn("__cx", F.explode(spans[0])).withColumn("__cy", F.explode(spans[1]))


def _level_size(cell: float) -> Column:
    return cell * F.pow(F.lit(float(LEVEL_STEP)), F.col("__level"))


def _blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the rows of full cells dealt into blocks (__i of the left, __j of the right), and the keys to join by.

    A row goes to its own block of its side with every block of the other: for two
    sides of n and m rows that is 2 * n * m / BLOCK rows for n * m pairs.
    """
    both = left.select(*keys, F.lit(1).alias("__n"), F.lit(0).alias("__m")).union(right.select(*keys, F.lit(0), F.lit(1)))
    count = both.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.sum("__m").alias("__m")).filter((F.least("__n", "__m") > 0) & (F.greatest("__n", "__m") > BLOCK))
    full = stored(count.select(*keys, F.ceil(F.col("__n") / BLOCK).alias("__ni"), F.ceil(F.col("__m") / BLOCK).alias("__nj")), "full")
    n_blocks = full.agg(F.sum(F.col("__ni") * F.col("__nj"))).first()[0]
    if not n_blocks:
        free(full)
        return left, right, keys
    n = min(20_000, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks // 4))
    dealt = []
    for side, (mine, of), (other, others) in ((left, ("__i", "__ni"), ("__j", "__nj")), (right, ("__j", "__nj"), ("__i", "__ni"))):
        digest = F.xxhash64(*[c for c, t in side.dtypes if "map<" not in t])
        out = side.join(full, keys, "left").withColumn(mine, F.pmod(digest, F.coalesce(of, F.lit(1))))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(others, F.lit(1)) - 1))).drop("__ni", "__nj")
        dealt.append(out.repartition(n, *keys, "__i", "__j"))
    return *dealt, [*keys, "__i", "__j"]


def bbox_join(left: DataFrame, right: DataFrame, cell: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of closed boxes (x1, y1, x2, y2) that meet, of equal columns ``on`` (nulls are equal): an equi-join on grid cells, refined.

    A pair is reported in one cell only, that of its overlap's lower corner, so
    nothing needs to be made distinct. Output: all other columns of both sides, ``on`` once.
    """
    names = {c: f"__r_{c}" for c in ("x1", "y1", "x2", "y2", "__fx", "__fy")}
    levels = [_own_levels(df, cell) for df in (left, right)]
    first = {f"__f{c}": F.floor(F.col(f"{c}1") / _level_size(cell)) for c in ("x", "y")}  # the lower corner's cell
    l, r = _cells(left, cell, _meetings(*levels, True)).withColumns(first), _cells(right, cell, _meetings(*levels[::-1], False)).withColumns(first)
    keys = ["__level", "__way", "__cx", "__cy"]
    if on:  # as a struct, whose nulls are equal
        l, r, keys = l.withColumn("__on", F.struct(*on)), r.withColumn("__on", F.struct(*on)).drop(*on), ["__on", *keys]
    for a, b in names.items():
        r = r.withColumnRenamed(a, b)
    l, r, keys = _blocks(l, r, keys)
    once = (F.greatest("__fx", names["__fx"]) == F.col("__cx")) & (F.greatest("__fy", names["__fy"]) == F.col("__cy"))
    both = l.join(r, keys).filter(bbox_meets(("x1", "y1", "x2", "y2"), tuple(names.values())[:4]) & once)
    return both.drop(*keys, *names, *names.values())


def _held(pairs: DataFrame, columns: list[str], more: dict[str, Column]) -> DataFrame:
    """Columns of joined pairs, with others computed once for filters on them that read __held too.

    __held is not deterministic, so that such filters stay behind the join: in its condition each
    column would be spelled out wherever it is read, in a method too long for the JIT compiler.
    """
    return pairs.select(*columns, *[c.alias(k) for k, c in more.items()], F.monotonically_increasing_id().alias("__held"))


def overlap_conflicts(boxes: DataFrame, threshold: float, cell: float, others: DataFrame | None = None) -> DataFrame:
    """a, b: boxes (det, cls, x1..y2) of one class whose intersection over union is above the threshold; b of ``others``, if given."""
    ends = ("x1", "y1", "x2", "y2")
    mine, other = (
        df.filter("cls is not null").select(F.col("det").alias(k), "cls", *[F.col(c).alias(k + c) for c in ends], *ends) for k, df in (("a", boxes), ("b", boxes if others is None else others))
    )
    pairs = bbox_join(mine, other, cell, on=("cls",))
    if others is None:
        pairs = pairs.filter("a < b")
    w = F.greatest(F.lit(0.0), F.least("ax2", "bx2") - F.greatest("ax1", "bx1"))
    h = F.greatest(F.lit(0.0), F.least("ay2", "by2") - F.greatest("ay1", "by1"))
    areas = (F.col("ax2") - F.col("ax1")) * (F.col("ay2") - F.col("ay1")) + (F.col("bx2") - F.col("bx1")) * (F.col("by2") - F.col("by1"))
    both = _held(pairs, ["a", "b"], {"__w": w, "__h": h, "__areas": areas})
    return both.filter((F.col("__held") >= 0) & (F.col("__w") * F.col("__h") > threshold * (F.col("__areas") - F.col("__w") * F.col("__h")))).select("a", "b")


def _home(cell: float) -> list[Column]:
    """Level and cell of a box's (x1 to y2) lower corner: by them the number of pairs is foreseen."""
    size = cell * F.pow(F.lit(float(LEVEL_STEP)), _own_level(cell))
    return [_own_level(cell).alias("__level"), F.floor(F.col("x1") / size).alias("__cx"), F.floor(F.col("y1") / size).alias("__cy")]


def nms(boxes: DataFrame, threshold: float = 0.5, cell: float = 64.0, most_pairs: int = 1_000_000) -> DataFrame:
    """Class-aware greedy suppression: best confidence first (ties: smallest det); kept boxes."""
    items = boxes.select(F.col("det").alias("id"), (-F.col("conf")).alias("rank"), "det", "cls", "x1", "y1", "x2", "y2", *_home(cell))
    base = greedy_set(items, ["cls", "__level", "__cx", "__cy"], lambda some, others: overlap_conflicts(some, threshold, cell, others), most_pairs)
    return boxes.join(base.filter("kept").select(F.col("id").alias("det")), "det", "left_semi")


def ept_bounds(json: Column) -> Column:
    """Box of a point-cloud descriptor: boundsConforming, else bounds, of six numbers or more; null otherwise."""
    d = F.from_json(json, "boundsConforming array<double>, bounds array<double>")
    b = F.coalesce(d["boundsConforming"], d["bounds"])
    return F.when(F.size(b) >= 6, F.struct(b[0].alias("xmin"), b[1].alias("ymin"), b[3].alias("xmax"), b[4].alias("ymax")))


# Geometry names and the kinds of layer that they make.
GEOMETRY_KINDS = {"point": "Point", "line": "LineString", "linestring": "LineString", "polyline": "LineString", "polygon": "Polygon", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon"}


def geometry_kind(name: Column) -> Column:
    """Kind of layer of a geometry name; the plan fails at run time on an unknown one."""
    kinds = F.create_map(*[F.lit(x) for kv in GEOMETRY_KINDS.items() for x in kv])
    found = F.element_at(kinds, F.lower(name))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown geometry type "), name))).otherwise(found)


def empty_layer(spark, fields: str = "grid_code int, class_name string") -> DataFrame:
    """A layer template without features."""
    return spark.createDataFrame([], f"fid long, geom struct<type:string,parts:array<array<struct<x:double,y:double>>>>, {fields}")


def points_in_box(points: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Points (px, py, ..) of a closed box; on Parquet the bounds reach the scan."""
    return points.filter(F.col("px").between(xmin, xmax) & F.col("py").between(ymin, ymax))


def exterior_rings(geom: Column) -> Column:
    """First ring of a polygon, or of each part of several."""
    return F.when(geom["type"] == "Polygon", F.slice(geom["parts"], 1, 1)).otherwise(geom["parts"])


def with_field(layer: DataFrame, name: str, value: Column) -> DataFrame:
    """Sets a field, replacing one of that name in whatever case."""
    same = [c for c in layer.columns if c.lower() == name.lower()]
    return layer.withColumn(same[0] if same else name, value)


def length_summary(layer: DataFrame, points: str, factor: float = 1.0) -> DataFrame:
    """One row: total length of the lines (arrays of points), lines counted, and features skipped (null or no line)."""
    ok = F.coalesce(F.size(points), F.lit(0)) >= 2
    return layer.agg(F.coalesce(F.sum(F.when(ok, line_length(F.col(points), factor))), F.lit(0.0)).alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("skipped"))


def segment_sides(a: tuple[Column, ...], b: tuple[Column, ...]) -> list[Column]:
    """On which side (-1, 0, 1) of segment a (x1, y1, x2, y2) the ends of b lie, and of b those of a."""

    def side(p, q, x, y):
        return F.signum((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]))

    a1, a2, b1, b2 = (a[0], a[1]), (a[2], a[3]), (b[0], b[1]), (b[2], b[3])
    return [side(a1, a2, *b1), side(a1, a2, *b2), side(b1, b2, *a1), side(b1, b2, *a2)]


def segments_meet(a: tuple[Column, ...], b: tuple[Column, ...], sides: list[Column] | None = None) -> Column:
    """Whether two closed segments (x1, y1, x2, y2) have a point in common, ends and overlaps included; ``sides``: theirs, if known."""
    a1, a2, b1, b2 = (a[0], a[1]), (a[2], a[3]), (b[0], b[1]), (b[2], b[3])
    s1, s2, s3, s4 = sides or segment_sides(a, b)

    def within(p, q, x, y):
        return x.between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & y.between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))

    crossing = (s1 * s2 <= 0) & (s3 * s4 <= 0) & ~((s1 == 0) & (s2 == 0) & (s3 == 0) & (s4 == 0))
    touching = ((s1 == 0) & within(a1, a2, *b1)) | ((s2 == 0) & within(a1, a2, *b2)) | ((s3 == 0) & within(b1, b2, *a1)) | ((s4 == 0) & within(b1, b2, *a2))
    return crossing | touching


def _segments(lines: DataFrame, key: str) -> DataFrame:
    """Each segment of lines (fid, grid_code, parts of points) with its box; the other columns begin with the key."""
    part = lines.select("fid", "grid_code", F.explode("parts").alias("p"))
    steps = F.arrays_zip(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("s"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("e"))
    seg = part.select("fid", "grid_code", F.explode(steps).alias("z")).select("fid", "grid_code", F.col("z.s.x").alias("sx"), F.col("z.s.y").alias("sy"), F.col("z.e.x").alias("ex"), F.col("z.e.y").alias("ey"))
    box = [F.least("sx", "ex").alias("x1"), F.least("sy", "ey").alias("y1"), F.greatest("sx", "ex").alias("x2"), F.greatest("sy", "ey").alias("y2")]
    return seg.select(F.col("fid").alias(key), "grid_code", *[F.col(c).alias(f"{key}_{c}") for c in ("sx", "sy", "ex", "ey")], *box)


def line_pairs(lines: DataFrame, cell: float, others: DataFrame | None = None) -> DataFrame:
    """a, b: lines (fid, grid_code, parts of points) of one code that intersect; segments meet in grid cells; b of ``others``, if given."""
    ends = ("sx", "sy", "ex", "ey")
    met = bbox_join(_segments(lines, "a"), _segments(lines if others is None else others, "b"), cell, on=("grid_code",))
    if others is None:
        met = met.filter("a < b")
    one, two = (tuple(F.col(f"{k}_{c}") for c in ends) for k in "ab")
    met = _held(met, ["a", "b", *[c for c in met.columns if c[:2] in ("a_", "b_")]], {f"__s{k}": c for k, c in enumerate(segment_sides(one, two))})
    return met.filter((F.col("__held") >= 0) & segments_meet(one, two, [F.col(f"__s{k}") for k in range(4)])).select("a", "b").distinct()


def dissolve(lines: DataFrame, cell: float, most_pairs: int = 1_000_000) -> DataFrame:
    """Greedy dissolve of lines (fid, grid_code, parts, ..): the lowest fid absorbs what intersects it itself, then the next that is left.

    Out: the attributes of each base, its members' number, and their parts together.
    Two members' parts are not cut where they cross.
    """
    points = F.flatten("parts")
    ends = [f(F.transform(points, lambda p: p[c])).alias(f"{c}{k}") for k, f in ((1, F.array_min), (2, F.array_max)) for c in ("x", "y")]
    items = lines.select(F.col("fid").alias("id"), F.col("fid").alias("rank"), "fid", "grid_code", "parts", *ends)
    items = items.select("id", "rank", "fid", "grid_code", "parts", *_home(cell))
    base = greedy_set(items, ["grid_code", "__level", "__cx", "__cy"], lambda some, others: line_pairs(some, cell, others), most_pairs).select(F.col("id").alias("fid"), "base")
    both = lines.join(base, "fid").groupBy("base").agg(F.count(F.lit(1)).alias("members"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("fid", "parts"))), lambda s: s["parts"])).alias("parts"))
    return lines.drop("parts").join(both.withColumnRenamed("base", "fid"), "fid")


def ept_scan(rows: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """prefix, ok, xmin, ymin, xmax, ymax, hit of descriptors (prefix, json): one that can't be read is not ok and no hit."""
    b = ept_bounds(F.col("json"))
    out = rows.select("prefix", b.alias("b"))
    hit = (F.col("b.xmin") <= xmax) & (F.col("b.xmax") >= xmin) & (F.col("b.ymin") <= ymax) & (F.col("b.ymax") >= ymin)
    return out.select("prefix", F.col("b").isNotNull().alias("ok"), "b.xmin", "b.ymin", "b.xmax", "b.ymax", F.coalesce(hit, F.lit(False)).alias("hit"))


def scan_matches(scan: DataFrame) -> DataFrame:
    """The scan's matches: distinct prefixes in order."""
    return scan.filter("hit").select("prefix").distinct().orderBy("prefix")
