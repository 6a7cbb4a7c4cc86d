"""Label datasets: parsing, validation, COCO, statistics, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Extensions of the images that annotation files may name.
ANNOTATED = ("jpg", "jpeg", "png", "bmp", "gif")


def tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def parse_labels(lines: DataFrame, least: int = 5, polygons_only: bool = False) -> DataFrame:
    """stem, line_no, class_id, coords of readable lines with at least ``least`` words.

    For masks (polygons_only) lines need seven words and an even number of coordinates.
    """
    t = lines.withColumn("__t", tokens(F.col("line"))).filter(F.size("__t") >= (7 if polygons_only else least))
    if polygons_only:
        t = t.filter((F.size("__t") % 2) == 1)
    t = t.withColumn("class_id", F.expr("cast(try_cast(__t[0] as double) as int)"))
    t = t.withColumn("coords", F.transform(F.slice("__t", 2, F.size("__t") - 1), lambda x: x.try_cast("double")))
    return t.filter("class_id is not null and not exists(coords, c -> c is null)").select("stem", "line_no", "class_id", "coords")


def _numbers(lines: DataFrame) -> DataFrame:
    """lines with ``__n``, their words as numbers (null: not numeric), of lines with any word; a generate keeps the parsing from being copied."""
    parsed = F.array(F.transform(tokens(F.col("line")), lambda x: x.try_cast("double")))
    return lines.select("stem", "line_no", F.explode(parsed).alias("__n")).filter(F.size("__n") > 0)


def issues_boxes(lines: DataFrame) -> DataFrame:
    """Validator A: one issue a line - too few words (under 5), not numeric, or a coordinate outside 0..1 (NaN passes)."""
    t = _numbers(lines)
    outside = F.exists(F.slice("__n", 2, F.size("__n")), lambda v: (v < 0) | ((v > 1) & ~F.isnan(v)))
    issue = F.when(F.size("__n") < 5, "too_few").when(F.exists("__n", lambda v: v.isNull()), "not_numeric").when(outside, "out_of_range")
    return t.withColumn("issue", issue).filter("issue is not null").select("stem", "line_no", "issue")


def issues_polygons(lines: DataFrame) -> DataFrame:
    """Validator B: shape (under 7 words or an odd number of coordinates), else not numeric, else class and range, which can coexist."""
    t = _numbers(lines)
    outside = F.exists(F.slice("__n", 2, F.size("__n")), lambda v: ~v.between(0, 1))
    both = F.array_compact(F.array(F.when(F.col("__n")[0] != F.floor(F.col("__n")[0]), F.lit("class_not_integer")), F.when(outside, F.lit("out_of_range"))))
    found = F.when((F.size("__n") < 7) | (F.size("__n") % 2 == 0), F.array(F.lit("bad_shape"))).when(F.exists("__n", lambda v: v.isNull()), F.array(F.lit("not_numeric"))).otherwise(both)
    return t.select("stem", "line_no", F.explode(found).alias("issue"))


def first_issues(issues: DataFrame, n: int = 20) -> DataFrame:
    """The report's first n issues, by file and line."""
    return issues.orderBy("stem", "line_no", "issue").limit(n)


def pixel_coords(coords: Column, w: Column, h: Column) -> Column:
    """Normalised coordinates in pixels; an odd one at the end is left out."""
    n = F.floor(F.size(coords) / 2).cast("int") * 2
    return F.transform(F.slice(coords, 1, n), lambda v, i: F.when(i % 2 == 0, v * w).otherwise(v * h))


def _bounds(xy: Column) -> Column:
    """x, y, width, height of a flat polygon; zeros under four numbers."""
    xs, ys = F.filter(xy, lambda v, i: i % 2 == 0), F.filter(xy, lambda v, i: i % 2 == 1)
    x, y = F.array_min(xs), F.array_min(ys)
    zero = F.array(*[F.lit(0.0)] * 4)
    return F.when(F.size(xy) < 4, zero).otherwise(F.array(x, y, F.array_max(xs) - x, F.array_max(ys) - y))


def coco_instances(labels: DataFrame, w: Column, h: Column) -> DataFrame:
    """Adds category_id, bbox, area, iscrowd, segmentation: four numbers are a box without segmentation, else a polygon."""
    c = F.col("coords")
    box = F.array((c[0] - c[2] / 2) * w, (c[1] - c[3] / 2) * h, c[2] * w, c[3] * h)
    out = labels.withColumn("__xy", pixel_coords(c, w, h)).withColumn("bbox", F.when(F.size(c) == 4, box).otherwise(_bounds(F.col("__xy"))))
    out = out.withColumn("segmentation", F.when(F.size(c) != 4, F.array("__xy")))
    return out.withColumn("category_id", F.col("class_id") + 1).withColumn("area", F.col("bbox")[2] * F.col("bbox")[3]).withColumn("iscrowd", F.lit(0)).drop("__xy")


def coco_categories(labels: DataFrame, names: list[str]) -> DataFrame:
    """id, name of all classes up to the largest seen; unnamed ones are class_{i}."""
    top = labels.agg(F.greatest(F.coalesce(F.max("class_id"), F.lit(-1)), F.lit(len(names) - 1)).alias("top"))
    ids = top.select(F.explode(F.when(F.col("top") >= 0, F.sequence(F.lit(0), F.col("top"))).otherwise(F.array().cast("array<int>"))).alias("k"))
    name = F.coalesce(F.get(F.array(*map(F.lit, names)).cast("array<string>"), F.col("k")), F.concat(F.lit("class_"), F.col("k").cast("string")))
    return ids.select((F.col("k") + 1).alias("id"), name.alias("name"))


def annotated_images(files: DataFrame) -> DataFrame:
    """Files (ext) that annotation files may name: no TIFF."""
    return files.filter(F.lower("ext").isin(*ANNOTATED))


def numbered(df: DataFrame, group: str, order: list[str], name: str = "id") -> DataFrame:
    """Adds 1, 2, .. within each group in the order of columns, without one task seeing a group."""
    ranked = global_rank(df, [group, *order])
    starts = ranked.groupBy(group).agg((F.min("rank") - 1).alias("__s"))
    return ranked.join(F.broadcast(starts), group).withColumn(name, F.col("rank") - F.col("__s")).drop("rank", "__s")  # a row a group


def coco_ids(images: DataFrame, instances: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(images (stem, split) with id, instances (stem, line_no, ..) with split, image_id and id): both are numbered from 1 in each split."""
    out = numbered(images.withColumn("__o", seeded(F.col("stem"), seed)), "split", ["__o", "stem"]).drop("__o")
    at = instances.join(out.select("stem", "split", F.col("id").alias("image_id")), "stem")
    return out, numbered(at, "split", ["image_id", "line_no"])


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, split: str) -> DataFrame:
    """part, at, text: the pieces of one split's COCO JSON in order; joined, they are the document. Nothing is gathered."""
    part = annotations.filter(F.col("split") == split).select("id", "image_id", "category_id", "bbox", "area", "iscrowd", "segmentation")
    lists = {"images": images.filter(F.col("split") == split).drop("split"), "annotations": part, "categories": categories}
    out = None
    for k, (name, rows) in enumerate(lists.items()):
        first = rows.agg(F.min("id").alias("__first")).withColumn("__k", F.lit(0))  # one row
        body = rows.withColumn("__k", F.lit(0)).join(F.broadcast(first), "__k").select(F.lit(2 * k + 1).alias("part"), F.col("id").cast("long").alias("at"), F.concat(F.when(F.col("id") == F.col("__first"), "").otherwise(","), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).alias("text"))
        head = rows.sparkSession.range(1).select(F.lit(2 * k).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(("{" if k == 0 else "],") + f'"{name}":[').alias("text"))
        out = head.union(body) if out is None else out.union(head).union(body)
    return out.union(out.sparkSession.range(1).select(F.lit(2 * len(lists)), F.lit(0).cast("long"), F.lit("]}"))).orderBy("part", "at")


def validate_images(images: DataFrame, labels: DataFrame, lines: DataFrame, least: float = 1.0) -> DataFrame:
    """Validator A over whole images: stem, line_no, issue.

    images: stem, std (null: unreadable); labels: stem of the label files; lines: their
    lines. An unreadable image has that issue only. A solid one (deviation under
    ``least``) is reported and goes on; without a label file it has no lines to check.
    """
    none = F.lit(None).cast("long")
    readable = images.filter("std is not null")
    files = labels.select("stem").distinct()
    out = images.filter("std is null").select("stem", none.alias("line_no"), F.lit("unreadable").alias("issue"))
    out = out.union(readable.filter(F.col("std") < least).select("stem", none, F.lit("solid_colour")))
    out = out.union(readable.select("stem").join(files, "stem", "left_anti").select("stem", none, F.lit("missing_label")))
    found = issues_boxes(lines).join(readable.select("stem").distinct(), "stem", "left_semi").join(files, "stem", "left_semi")
    return out.union(found.select("stem", F.col("line_no").cast("long"), "issue"))


def top_detections(detections: DataFrame, n: int = 300) -> DataFrame:
    """The n best detections (tile, det, conf) of each tile; ties: smallest det."""
    best = F.row_number().over(Window.partitionBy("tile").orderBy(F.col("conf").desc(), "det"))
    return detections.withColumn("__r", best).filter(F.col("__r") <= n).drop("__r")


def yolo_text(labels: DataFrame, tiles: DataFrame) -> DataFrame:
    """stem, text: one line an instance with six decimals; tiles without any keep an empty text."""
    line = F.concat_ws(" ", F.col("class_id").cast("string"), F.array_join(F.transform("coords", lambda v: F.format_string("%.6f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))), " "))
    body = labels.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))
    return tiles.select("stem").distinct().join(body, "stem", "left").select("stem", F.coalesce("text", F.lit("")).alias("text"))


def density_bins(samples: DataFrame, k: int) -> DataFrame:
    """Adds bin: k slices of nearly equal size by (density, stem); the remainder goes to the last ones.

    Ranks come from a range-partitioned sort with per-partition counts, not from one window over all rows.
    """
    ranked = global_rank(samples, ["density", "stem"])
    total = F.lit(samples.count())
    return ranked.withColumn("bin", F.floor((F.lit(k) * F.col("rank") - 1) / total).cast("int")).drop("rank")


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds rank, 1 to n in the order of columns, without one task seeing all rows."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    from geoloom.session import stored

    parts = stored(parts, "ranked")
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return parts.join(F.broadcast(sizes.select("__p", before.alias("__b"))), "__p").withColumn("rank", F.col("__b") + F.col("__k")).drop("__p", "__k", "__b")


def bin_quotas(sizes: list[int], val_n: int) -> list[int]:
    """Validation rows of each bin: rounded shares (halves to even), then mended by one in turn until they sum to val_n."""
    n = sum(sizes)
    quotas = [round(val_n * s / n) if n else 0 for s in sizes]
    k = 0
    while sum(quotas) != val_n:
        step = 1 if sum(quotas) < val_n else -1
        if 0 <= quotas[k % len(sizes)] + step <= sizes[k % len(sizes)]:
            quotas[k % len(sizes)] += step
        k += 1
    return quotas


def seeded(stem: Column, seed: int) -> Column:
    """Order of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), stem))


def stratified_split(samples: DataFrame, k: int, val_ratio: float, seed: int = 42) -> DataFrame:
    """Adds bin and split: each density bin gives its quota to val, chosen by the seeded order.

    ``k`` numbers reach the driver. Ranks are taken within salted parts of a bin
    only as far as its quota goes, then among those that are left.
    """
    binned = density_bins(samples, k)
    sizes = {r.bin: r["count"] for r in binned.groupBy("bin").count().collect()}
    counts = [sizes.get(b, 0) for b in range(k)]
    quotas = bin_quotas(counts, round(sum(counts) * val_ratio))
    return _take(binned, "bin", dict(enumerate(quotas)), seed)


def _take(df: DataFrame, group: str, quotas: dict[int, int], seed: int) -> DataFrame:
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(group))
    ranked = global_rank(df.withColumn("__o", seeded(F.col("stem"), seed)), [group, "__o", "stem"])
    starts = ranked.groupBy(group).agg((F.min("rank") - 1).alias("__s"))
    out = ranked.join(F.broadcast(starts), group)  # a row a group
    return out.withColumn("split", F.when(F.col("rank") - F.col("__s") <= quota, "val").otherwise("train")).drop("rank", "__s", "__o")


def random_split(samples: DataFrame, val_ratio: float, seed: int = 42, floor: bool = False) -> DataFrame:
    """Adds split: n x ratio rows (rounded, halves to even; or cut off) go to val by the seeded order."""
    n = samples.count()
    val_n = int(n * val_ratio) if floor else round(n * val_ratio)
    ranked = global_rank(samples.withColumn("__o", seeded(F.col("stem"), seed)), ["__o", "stem"])
    return ranked.withColumn("split", F.when(F.col("rank") <= val_n, "val").otherwise("train")).drop("rank", "__o")


def density_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("density").alias("mean"), F.min("density").alias("lo"), F.max("density").alias("hi"))


def dataset_plan(split: DataFrame) -> DataFrame:
    """Copies of images and labels into the folders of their split."""
    to = F.array(
        F.struct(F.col("img_path").alias("src"), F.concat(F.lit("images/"), "split", F.lit("/"), F.element_at(F.split("img_path", "/"), -1)).alias("dst")),
        F.struct(F.col("lbl_path").alias("src"), F.concat(F.lit("labels/"), "split", F.lit("/"), F.element_at(F.split("lbl_path", "/"), -1)).alias("dst")),
    )
    return split.select(F.explode(to).alias("c")).select(F.lit("copy").alias("action"), "c.src", "c.dst")


def dataset_yaml(root: str, names: list[str]) -> str:
    """The dataset's description, in JSON, which is YAML too."""
    import json

    return json.dumps({"path": root, "train": "images/train", "val": "images/val", "nc": len(names), "names": names}, ensure_ascii=False, indent=2)
