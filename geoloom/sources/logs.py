"""Logs and cached descriptors: CSV with a fixed header, JSON lines, JSON files that may be broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


def write_csv_log(rows: DataFrame, path: str, columns: list[str], bom: bool = False) -> None:
    """Rows as CSV files with a header of fixed columns (missing ones are empty), marked as UTF-8 for spreadsheets if asked."""
    known = [(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias((BOM if bom and k == 0 else "") + c) for k, c in enumerate(columns)]
    rows.select(*known).write.option("header", True).option("escape", '"').csv(path)


def write_json_log(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls spelt out."""
    rows.write.option("ignoreNullFields", False).json(path)


def cached_json(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """prefix, ok, json, error of cached descriptors: one that is no JSON object has ok false and a reason, and no json."""
    f = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    prefix = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    return checked_json(f.select(prefix.alias("prefix"), F.col("value").alias("json")))


def checked_json(rows: DataFrame) -> DataFrame:
    """prefix, ok, json, error of texts (prefix, json): see ``cached_json``."""
    ok = F.coalesce(F.size(F.json_object_keys("json")) >= 0, F.lit(False)) & F.col("json").isNotNull()
    error = F.when(F.col("json").isNull(), "no such descriptor").when(~ok, "not a JSON object")
    return rows.select("prefix", ok.alias("ok"), F.when(ok, F.col("json")).alias("json"), error.alias("error"))
