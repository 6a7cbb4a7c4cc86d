"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows: a seeded hash of the key and the shard count give the
shard, a second seeded hash gives one of the shard's memory-sized buckets.
Pass two Fisher-Yates shuffles each bucket's places (Spark's seeded ``shuffle``) and
lays the buckets of a shard end to end. Whole records are moved and written; the
query's digests are those of the shards read back.

Shard law ``key``: a row starts in shard 0 and moves to shard s, for s = 1, 2,
.., n - 1, where its s-th seeded hash is divisible by s + 1. So the key and the
number of shards alone decide, sizes are even in expectation, and shard n,
once added, takes rows only into itself.

Null keys hash like a key of their own; a null text has size 8 and the crc of
the empty text; equal rows are told apart by a copy number, so that even a
third of all rows being one row spread over the buckets of its shard. An empty
table gives an empty result. Other columns go along, whatever their names; maps
whose entries are listed in another order are not equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, MapType, StructField, StructType
from pyspark.sql.window import Window

from geoloom.session import scratch_path, stored

SHARDS = 24
SEED = 20240229
#: Payload that one bucket should hold; half of what a task may have.
BUCKET_BYTES = 64 << 20
#: Hashes of rows that occur more than once (8 bytes each) up to which they are broadcast.
BROADCAST_REPEATED = 500_000
#: Copies of one row that a task makes at a time.
COPIES = 1000


def shard_of(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """Shard 0 to n_shards - 1 of a key under the law ``key``."""
    moves = [F.when(F.pmod(F.xxhash64(key, F.lit(s), F.lit(seed)), F.lit(s + 1)) == 0, F.lit(s)) for s in range(1, n_shards)]
    return F.greatest(F.lit(0), *moves) if moves else F.lit(0)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def shuffle_buckets(df: DataFrame, shard: str, bucket: str, order: list[str], seed: int, n_shards: int) -> DataFrame:
    """Fisher-Yates order within every (shard, bucket): adds ``slot``, gapless from 0 in a shard.

    The places of a bucket's rows are shuffled, and its rows, sorted by ``order``,
    take them; so rows are only ever sorted, which spills, and never gathered. The
    shuffled places are stored, so a task that runs again gives the same slots.
    They are made with a partition for each shard, numbered like it, in order of
    buckets: what Spark's generator is seeded with is the shard, at any number of
    shuffle partitions.
    """
    keys = [shard, bucket]
    rest = [c for c in df.columns if c not in keys]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    offsets = offsets.repartitionById(n_shards, F.col(shard)).sortWithinPartitions(bucket)
    places = F.shuffle(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int")), F.lit(seed))
    places = stored(offsets.select(*keys, "__offset", places.alias("__places")), "places")
    rows = df.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    slot = (F.col("__offset") + F.element_at("__places", F.col("__pos"))).cast("long")
    return rows.join(places, keys).select(shard, *rest, slot.alias("slot"))


def number_copies(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """row, h, copy of rows (row, h): equal rows are numbered from 1; repeated has each h of more than one row.

    Equal rows meet as one row and its count. They are made again COPIES at a
    time, so that no task makes all of them.
    """
    n = repeated.count()
    if not n:
        return rows.withColumn("copy", F.lit(1).cast("long"))
    repeated = F.broadcast(repeated) if n <= BROADCAST_REPEATED else repeated
    single = rows.join(repeated, "h", "left_anti").select("row", "h", F.lit(1).cast("long").alias("copy"))
    many = rows.join(repeated, "h", "left_semi").groupBy("row", "h").agg(F.count(F.lit(1)).alias("n"))
    many = many.withColumn("first", F.explode(F.expr(f"sequence(1L, n, {COPIES}L)"))).repartition("h", "first")
    return single.union(many.select("row", "h", F.explode(F.expr(f"sequence(first, least(n, first + {COPIES - 1}))")).alias("copy")))


def _packed(docs: DataFrame) -> list[Column]:
    """Columns of docs, maps as lists of entries: those can be hashed and compared."""
    return [F.map_entries(f.name).alias(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in docs.schema]


def _unpacked(docs: DataFrame) -> Column:
    """The row of docs, of its packed columns."""
    return F.struct(*[(F.map_from_entries(F.col("row")[f.name]) if isinstance(f.dataType, MapType) else F.col("row")[f.name]).alias(f.name) for f in docs.schema])


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Whole rows, shuffled, as Parquet (slot, row) under ``path/shard=S``, in the order of their slots within a file."""
    rows = docs.select(F.struct(*_packed(docs)).alias("row")).withColumn("h", F.xxhash64("row"))
    hashes = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(text_size(F.col("row.text"))).alias("size")), "hashes")
    total = hashes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (n_shards * bucket_bytes)))
    rows = number_copies(rows, hashes.filter("n > 1").select("h"))
    bucket = F.pmod(F.xxhash64("h", "copy", F.lit(seed + 1)), F.lit(buckets)).cast("int")
    rows = rows.select(shard_of(F.col("row.doc_id"), n_shards, seed).alias("shard"), bucket.alias("bucket"), "h", "copy", "row")
    out = shuffle_buckets(rows, "shard", "bucket", ["h", "copy"], seed, n_shards).select("shard", "slot", _unpacked(docs).alias("row"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_rows(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (one more shard) of every row of the shards, written and read back."""
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, n_shards, seed, bucket_bytes)
    schema = StructType([StructField("slot", LongType()), StructField("row", docs.schema), StructField("shard", IntegerType())])
    key, text = F.col("row.doc_id"), F.col("row.text")
    grown = F.when(F.pmod(F.xxhash64(key, F.lit(n_shards), F.lit(seed)), F.lit(n_shards + 1)) == 0, F.lit(n_shards)).otherwise(F.col("shard"))
    crc = F.crc32(F.coalesce(text, F.lit("")))
    back = docs.sparkSession.read.schema(schema).parquet(path)
    return back.select(key.alias("doc_id"), text_size(text).alias("size"), crc.alias("text_crc32"), "shard", "slot", grown.alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``key``."""
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op3_sharding": op3_sharding}
SQL: dict[str, str] = {}
