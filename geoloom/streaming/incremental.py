"""Incremental batches: files that have arrived since the last run, each processed once.

Not windows over event time: the mechanism is "skip what exists", either by an
anti-join against the outputs (``operators.files.todo``) or, here, by the
checkpoint of a file stream that ends when it has caught up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BINARY = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """A stream of the files of a folder."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def process_new(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs an operator over what is new and appends its rows as Parquet, exactly once; ends when caught up."""
    rows = operator(stream)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
