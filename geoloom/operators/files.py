"""File inventories as relations: pairing, audits, and plans of renames, copies and deletions.

Nothing here touches a file: plans are rows (action, src, dst) for a caller to carry out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Extensions of a complete Shapefile bundle; image extensions by priority.
BUNDLE = ("shp", "shx", "dbf", "prj", "cpg", "sbn", "sbx", "shp.xml")
IMAGE_PRIORITY = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def strip_suffixes(stem: Column, suffixes: list[str]) -> Column:
    """Removes any of the suffixes from the end, again and again, whatever their case."""
    import re

    return F.regexp_replace(stem, "(?i)(" + "|".join(map(re.escape, suffixes)) + ")+$", "")


def split_name(name: Column) -> tuple[Column, Column]:
    """(stem, lower-case extension); .shp.xml is one extension."""
    ext = F.lower(F.regexp_extract(name, r"(?i)\.(shp\.xml|[^.]+)$", 1))
    return F.regexp_replace(name, r"(?i)\.(shp\.xml|[^.]+)$", ""), ext


def pairing_report(left: DataFrame, right: DataFrame, key: str = "stem") -> DataFrame:
    """One row: counts of both sides, of matches, and of what is missing on either side."""
    a = left.select(key).distinct().withColumn("__l", F.lit(1))
    b = right.select(key).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(
        F.count("__l").alias("left_count"), F.count("__r").alias("right_count"), F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("matched_count"),
        F.count_if(F.col("__r").isNull()).alias("missing_on_right"), F.count_if(F.col("__l").isNull()).alias("missing_on_left"),
    )


def missing(left: DataFrame, right: DataFrame, key: str = "stem") -> DataFrame:
    """Names on the left that the right lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def require_match(left: DataFrame, right: DataFrame, key: str = "stem") -> DataFrame:
    """left, if every name of it is on the right; the plan fails at run time on the first that is not."""
    known = right.select(key).distinct().withColumn("__r", F.lit(True))
    out = left.join(known, key, "left")
    check = F.when(F.col("__r").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key)))).otherwise(F.lit(True))
    return out.filter(check).drop("__r")


def unique_names(files: DataFrame, key: str) -> DataFrame:
    """Names that more than one file has (an index on the name needs this to be empty)."""
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def bundle_check(rasters: DataFrame, parts: DataFrame) -> DataFrame:
    """stem, status, missing: rasters without a bundle, with parts missing (sorted), and bundles without a raster."""
    have = parts.filter(F.col("ext").isin(*BUNDLE)).groupBy("stem").agg(F.collect_set("ext").alias("exts"))
    both = rasters.select("stem").distinct().withColumn("__r", F.lit(1)).join(have, "stem", "full")
    lacks = F.array_sort(F.array_except(F.array(*map(F.lit, BUNDLE)), F.col("exts")))
    status = F.when(F.col("exts").isNull(), "no_bundle").when(F.col("__r").isNull(), "no_raster").when(F.size(lacks) > 0, "incomplete").otherwise("complete")
    return both.select("stem", status.alias("status"), F.when(status == "incomplete", F.array_join(lacks, ",")).otherwise(F.lit("")).alias("missing"))


def orphan_plan(images: DataFrame, labels: DataFrame, mode: str = "both") -> DataFrame:
    """Deletions of images without a label and of labels without an image (mode both, images or labels)."""
    a = images.join(labels.select("stem"), "stem", "left_anti").select(F.lit("delete_image").alias("action"), F.col("path").alias("src"))
    b = labels.join(images.select("stem"), "stem", "left_anti").select(F.lit("delete_label").alias("action"), F.col("path").alias("src"))
    return {"both": a.union(b), "images": a, "labels": b}[mode]


def label_samples(images: DataFrame, labels: DataFrame) -> DataFrame:
    """stem, img_path, lbl_path, density: each label with its image, the first extension of the priority winning."""
    rank = F.array_position(F.array(*map(F.lit, IMAGE_PRIORITY)), F.col("ext"))
    best = images.filter(rank > 0).groupBy("stem").agg(F.min_by("path", rank).alias("img_path"))
    return labels.join(best, "stem").select("stem", "img_path", F.col("path").alias("lbl_path"), "density")


def last_extension(images: DataFrame, order: list[str]) -> DataFrame:
    """One file of each stem: the one whose extension comes last in the order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("ext"))
    return images.filter(rank > 0).groupBy("stem").agg(F.max_by("path", rank).alias("path"))


def flatten_plan(files: DataFrame) -> DataFrame:
    """Copies of files (path, name) into one folder, in order of path: each takes the first free of its name and name_1, name_2, ..

    A numbered name may be another file's own, so files whose names differ by
    such numbers only are one family and are gone through in order. A family
    with one name needs no going through: its files are numbered. The walk holds
    the names that a family has taken, and reads its files in a stream.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    each = files.select("path", "name", stem.alias("stem"), ext.alias("ext"), F.concat(F.regexp_replace(stem, r"(_[0-9]+)+$", ""), ext).alias("family"))
    mixed = each.groupBy("family").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).filter("lo <> hi").select("family")
    k = F.row_number().over(Window.partitionBy("name").orderBy("path")) - 1
    plain = each.join(mixed, "family", "left_anti")
    plain = plain.select("path", F.when(k == 0, F.col("name")).otherwise(F.concat("stem", F.lit("_"), k.cast("string"), "ext")).alias("dst"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, taken, following = None, set(), {}
        for b in batches:
            out = []
            for f, name, s, e in zip(*(b.column(c).to_pylist() for c in ("family", "name", "stem", "ext"))):
                if f != family:
                    family, taken, following = f, set(), {}
                number, want = following.get(name, 0), name
                if number or name in taken:
                    number = max(number, 1)
                    while f"{s}_{number}{e}" in taken:
                        number += 1
                    want = f"{s}_{number}{e}"
                following[name] = number + 1
                taken.add(want)
                out.append(want)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], ["path", "dst"])

    ordered = each.join(mixed, "family", "left_semi").select("family", "path", "name", "stem", "ext").repartition("family").sortWithinPartitions("family", "path")
    both = plain.unionByName(ordered.mapInArrow(walk, "path string, dst string"))
    return both.select(F.lit("copy").alias("action"), F.col("path").alias("src"), "dst")


def rename_plan(files: DataFrame, remove: str, suffix: str = "") -> DataFrame:
    """Renames of files (stem, ext) without a text in the stem; unchanged and taken names are skipped.

    Of several files that want one name, the smallest stem gets it.
    """
    new = F.concat(F.replace(F.col("stem"), F.lit(remove), F.lit("")), F.lit(suffix))
    want = files.withColumn("new_stem", new).filter("new_stem <> stem")
    free = want.join(files.select(F.col("stem").alias("new_stem"), "ext"), ["new_stem", "ext"], "left_anti")
    first = free.groupBy("new_stem", "ext").agg(F.min("stem").alias("stem"))
    return first.select(F.lit("rename").alias("action"), F.concat_ws(".", "stem", "ext").alias("src"), F.concat_ws(".", "new_stem", "ext").alias("dst"))


def delete_plan(files: DataFrame, part: str) -> DataFrame:
    """Deletions of files whose name holds a text (case counts)."""
    return files.filter(F.col("name").contains(part)).select(F.lit("delete").alias("action"), F.col("path").alias("src"))


def todo(inputs: DataFrame, outputs: DataFrame, overwrite: bool = False) -> DataFrame:
    """Inputs with a status: processed if they are still to do, skipped_existing else."""
    done = outputs.select("stem").distinct().withColumn("__d", F.lit(True))
    status = F.lit("processed") if overwrite else F.when(F.col("__d"), "skipped_existing").otherwise("processed")
    return inputs.join(done, "stem", "left").withColumn("status", status).drop("__d")


def suffix_index(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """key, path of files (stem, path): stems without their suffixes; the plan fails at run time on two files of one key."""
    out = files.groupBy(strip_suffixes(F.col("stem"), suffixes).alias("key")).agg(F.min("path").alias("path"), F.max("path").alias("__other"), F.count(F.lit(1)).alias("__n"))
    clash = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("names collide: "), F.col("path"), F.lit(", "), F.col("__other")))).otherwise(F.lit(True))
    return out.filter(clash).select("key", "path")


def suffix_join(left: DataFrame, right: DataFrame, suffixes: list[str]) -> DataFrame:
    """key, left_path, right_path of files whose stems are equal without their suffixes."""
    a, b = suffix_index(left, suffixes).withColumnRenamed("path", "left_path"), suffix_index(right, suffixes).withColumnRenamed("path", "right_path")
    return a.join(b, "key")


def tile_folders(layers: DataFrame, folders: DataFrame, suffixes: list[str]) -> DataFrame:
    """stem, output_name, folder, status of layers (stem): the folder (folder) of their stripped name, else of their own; no_folder is a warning."""
    have = folders.select("folder").distinct()
    named = layers.select("stem", strip_suffixes(F.col("stem"), suffixes).alias("output_name"))
    first, second = have.select(F.col("folder").alias("output_name"), F.col("folder").alias("__a")), have.select(F.col("folder").alias("stem"), F.col("folder").alias("__b"))
    out = named.join(first, "output_name", "left").join(second, "stem", "left").withColumn("folder", F.coalesce("__a", "__b"))
    return out.select("stem", "output_name", "folder", F.when(F.col("folder").isNull(), "no_folder").otherwise("matched").alias("status"))


def label_density(files: DataFrame, by: str = "lines") -> DataFrame:
    """stem, density of label files (stem, text): lines that are not blank, or bytes."""
    lines = F.size(F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != ""))
    return files.select("stem", {"lines": lines, "bytes": F.octet_length("text")}[by].cast("long").alias("density"))


def union_distinct(*lists: DataFrame) -> DataFrame:
    """Files of several listings (case variants of a pattern, say), once each."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.distinct()


def workflow_counts(tiles: DataFrame, rgb_images: DataFrame, labels: DataFrame, split: DataFrame) -> DataFrame:
    """One row: tiles, rgb_images, labels, train, val."""
    kinds = {"tiles": tiles, "rgb_images": rgb_images, "labels": labels}
    rows = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n") for name, f in kinds.items()]
    rows.append(split.groupBy(F.col("split").alias("kind")).agg(F.count(F.lit(1)).alias("n")))
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    return every.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in (*kinds, "train", "val")])


def json_report(counts: DataFrame) -> DataFrame:
    """report: a row of counts as JSON text."""
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("report"))


def batch_log(inputs: DataFrame, outputs: DataFrame, root: str, suffix: str = "", overwrite: bool = False) -> DataFrame:
    """src, dst, status of files (path, stem, ext) below a folder: outputs keep their place relative to it; what exists is skipped."""
    relative = F.when(F.col("path").startswith(root), F.substr(F.col("path"), F.lit(len(root) + 1))).otherwise(F.col("path"))
    folder = F.regexp_extract(relative, r"^(.*/)?[^/]*$", 1)
    named = inputs.select(F.col("path").alias("src"), F.concat(folder, F.col("stem"), F.lit(suffix + "."), F.col("ext")).alias("dst"))
    done = outputs.select(F.col("path").alias("dst")).distinct().withColumn("__d", F.lit(True))
    status = F.lit("processed") if overwrite else F.when(F.col("__d"), "skipped_existing").otherwise("processed")
    return named.join(done, "dst", "left").select("src", "dst", status.alias("status"))
