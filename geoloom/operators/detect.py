"""Detections: decoding, mask probability, and pixel-wise merges of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode(raw: DataFrame, n_classes: int, least_conf: float, width: int, height: int) -> DataFrame:
    """det, cls, conf, box and coef of rows (det, v): centre, size, class scores, mask coefficients.

    The best class is the first of the highest score; confidence must be above
    the threshold; boxes are in pixels, clipped to the image.
    """
    v = F.col("v")
    scores = F.slice(v, 5, n_classes)
    conf = F.array_max(scores)
    out = raw.withColumn("conf", conf).filter(F.col("conf") > least_conf)
    cls = (F.array_position(scores, F.col("conf")) - 1).cast("int")

    def clip(c: Column, most: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), c))

    return out.select(
        "det", cls.alias("cls"), "conf",
        clip((v[0] - v[2] / 2) * width, width - 1).alias("x1"), clip((v[1] - v[3] / 2) * height, height - 1).alias("y1"),
        clip((v[0] + v[2] / 2) * width, width - 1).alias("x2"), clip((v[1] + v[3] / 2) * height, height - 1).alias("y2"),
        F.slice(v, 5 + n_classes, F.size(v)).alias("coef"),
    )


def mask_probability(coef: Column, proto: Column) -> Column:
    """Logistic of the product of coefficients and a prototype's values at one pixel."""
    return 1 / (1 + F.exp(-F.aggregate(F.zip_with(coef, proto, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def merge_strict(px: DataFrame, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Class and confidence of each pixel (y, x): the highest above 0; of equal ones the first seq."""
    best = px.filter("conf > 0").groupBy(*keys).agg(F.max(F.struct("conf", (-F.col("seq")).alias("s"), "cls")).alias("b"))
    return best.select(*keys, "b.cls", "b.conf")


def merge_priority(px: DataFrame) -> DataFrame:
    """Class and confidence of each pixel: highest priority, then confidence; of equal ones the last seq."""
    best = px.groupBy("y", "x").agg(F.max(F.struct("pri", "conf", "seq", "cls")).alias("b"))
    return best.select("y", "x", "b.cls", "b.conf")


def class_confidence(px: DataFrame, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Highest confidence of each class at each pixel."""
    return px.groupBy(*keys, "cls").agg(F.max("conf").alias("conf"))


def small_instances(pixels: DataFrame, keys: list[str], least: int = 100) -> DataFrame:
    """keys, n of the instances whose mask, cut to its box, has ``least`` pixels or more."""
    return pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
