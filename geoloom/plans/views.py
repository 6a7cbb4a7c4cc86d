"""Surrogate relations over the star tables: the same rows in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    """Ten rasters: a label's vectors are its rows, their elements the columns."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", F.col("label").cast("int").alias("raster_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y"), "embedding")
    out = e.select("raster_id", "y", "vec_id", F.posexplode("embedding").alias("x", "e"))
    v = F.col("e").cast("double") * 1000
    if holes:
        v = F.when((F.col("vec_id") * 64 + F.col("x")) % 97 == 0, F.lit(-9999.0)).otherwise(v)
    return out.select("raster_id", "y", "x", v.alias("v"))


def _px_sql(name: str, v: str) -> str:
    return f"""{name} as (
  select raster_id, y, i - 1 as x, {v} as v from (
    select label as raster_id, row_number() over (partition by label order by vec_id) - 1 as y, vec_id, embedding, unnest(range(1, 65)) as i from embeddings))"""


PX = _px_sql("px", "cast(embedding[i] as double) * 1000")
PXN = _px_sql("pxn", "case when (vec_id * 64 + i - 1) % 97 = 0 then -9999.0 else cast(embedding[i] as double) * 1000 end")
#: Sobel and Laplacian of column f of relation src.
GRADIENTS = """rowpass as (
  select *, coalesce(lag(f) over r, lead(f) over r, f) as l, coalesce(lead(f) over r, lag(f) over r, f) as g from src window r as (partition by raster_id, y order by x)
), mid as (select *, g - l as q, l + 2 * f + g as p, l + g as s from rowpass
), sides as (
  select *, coalesce(lag(q) over c, lead(q) over c, q) as qu, coalesce(lead(q) over c, lag(q) over c, q) as qd,
    coalesce(lag(p) over c, lead(p) over c, p) as pu, coalesce(lead(p) over c, lag(p) over c, p) as pd,
    coalesce(lag(s) over c, lead(s) over c, s) as su, coalesce(lead(s) over c, lag(s) over c, s) as sd
  from mid window c as (partition by raster_id, x order by y)
), grad as (select *, qu + 2 * q + qd as dx, pd - pu as dy, 2 * (su + sd) - 8 * f as curv from sides)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line network with scale-free degrees."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("fid"), F.col("o_custkey").alias("u"), (1000000 + F.floor(F.col("o_orderkey") * 4 / F.lit(5))).alias("v"), F.col("o_totalprice").alias("len"))


EDGES = "edges as (select o_orderkey as fid, o_custkey as u, 1000000 + (o_orderkey * 4) // 5 as v, o_totalprice as len from orders)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: 40 x 40 boxes placed by the first elements of a vector."""
    e = table(spark, sf_dir, "embeddings")
    d = [F.col("embedding")[k].cast("double") for k in range(5)]
    return e.select(F.col("vec_id").alias("det"), F.col("label").cast("int").alias("cls"), d[4].alias("conf"), (d[0] * 100).alias("x1"), (d[1] * 100).alias("y1"), (d[0] * 100 + 40).alias("x2"), (d[1] * 100 + 40).alias("y2"))


BOXES = """boxes as (select vec_id as det, label as cls, cast(embedding[5] as double) as conf, cast(embedding[1] as double) * 100 as x1, cast(embedding[2] as double) * 100 as y1,
  cast(embedding[1] as double) * 100 + 40 as x2, cast(embedding[2] as double) * 100 + 40 as y2 from embeddings)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised label coordinates: 4, 6, 8 or 10 numbers by vec_id % 4."""
    e = table(spark, sf_dir, "embeddings")
    coords = F.transform(F.slice("embedding", 1, F.lit(4) + 2 * (F.col("vec_id") % 4).cast("int")), lambda v: F.abs(v.cast("double")))
    return e.select(F.col("label").cast("int").alias("class_id"), F.concat(F.lit("img_"), (F.col("vec_id") % 50).cast("string")).alias("stem"), F.col("vec_id").alias("line_no"), coords.alias("coords"))


POLYGONS = "poly as (select label as class_id, 'img_' || (vec_id % 50) as stem, vec_id as line_no, list_transform(embedding[1:4 + 2 * (vec_id % 4)], lambda v: abs(cast(v as double))) as coords from embeddings)"


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label text, some of it broken: too short, odd, not numeric, out of range."""
    li = table(spark, sf_dir, "lineitem")
    tail = F.when(F.col("l_linenumber") == 3, F.lit("0.5 0.5 x")).when(F.col("l_linenumber") == 4, F.lit("")).when(F.col("l_linenumber") == 5, F.lit("0.1 0.9 1.5")).otherwise(F.lit("0.25 0.75 0.5"))
    text = F.concat_ws(" ", F.col("l_linenumber") % 2, F.col("l_discount").cast("string"), F.col("l_tax").cast("string"), F.lit("0.5"), tail)
    return li.select(F.concat(F.lit("t"), (F.col("l_orderkey") % 400).cast("string")).alias("stem"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), text.alias("line"))


LABEL_LINES = """lines as (select 't' || (l_orderkey % 400) as stem, l_orderkey * 10 + l_linenumber as line_no,
  concat_ws(' ', l_linenumber % 2, cast(l_discount as varchar), cast(l_tax as varchar), '0.5',
    case l_linenumber when 3 then '0.5 0.5 x' when 4 then '' when 5 then '0.1 0.9 1.5' else '0.25 0.75 0.5' end) as line from lineitem)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files, one for each document; every fifth stem has a second one."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", "png").when(F.col("lang") == "de", "jpg").otherwise("tif")
    exts = F.when(F.col("doc_id") % 5 == 0, F.array(ext, F.lit("webp"))).otherwise(F.array(ext))
    d = d.select(F.col("doc_id").cast("string").alias("stem"), F.explode(exts).alias("ext"))
    return d.withColumn("path", F.concat(F.lit("images/"), "stem", F.lit("."), "ext"))


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files; every seventh has a stem of no image."""
    stem = F.concat(F.when(F.col("doc_id") % 7 == 0, "lost_").otherwise(""), F.col("doc_id").cast("string"))
    l = table(spark, sf_dir, "labels").select(stem.alias("stem"), (F.col("doc_id") % 23).alias("density"))
    return l.select("stem", F.concat(F.lit("labels/"), "stem", F.lit(".txt")).alias("path"), "density")


IMAGES = """imgs as (
  select stem, ext, 'images/' || stem || '.' || ext as path from (
    select cast(doc_id as varchar) as stem, unnest(case when doc_id % 5 = 0 then [e, 'webp'] else [e] end) as ext
    from (select doc_id, case lang when 'en' then 'png' when 'de' then 'jpg' else 'tif' end as e from documents))),
lbls as (select stem, 'labels/' || stem || '.txt' as path, density from (select case when doc_id % 7 = 0 then 'lost_' else '' end || doc_id as stem, doc_id % 23 as density from labels))"""
