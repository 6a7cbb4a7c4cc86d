import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from geoloom.llm import sharding


def h(seed, x, n):
    return xxhash.xxh64_intdigest(x.to_bytes(n, "little", signed=True), seed=seed)


def brute_shard(doc_id, n, seed=sharding.SEED):
    """Spark chains columns: each one's hash is the next one's seed."""
    shard = 0
    for s in range(1, n):
        x = h(h(h(42, doc_id, 8), s, 4), seed, 4)
        x = x - (1 << 64) if x >> 63 else x
        if x % (s + 1) == 0:
            shard = s
    return shard


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, slot int")


def check(rows, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, n)
    for s, x in slots.items():
        assert sorted(x) == list(range(len(x))), s


def test_query_against_brute_force(spark, sf_dir):
    rows = sharding.op3_sharding(spark, sf_dir).collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key")
        assert r.shard == brute_shard(r.doc_id, 24) and r.grown_shard == brute_shard(r.doc_id, 25)
    check(rows, 24)


def test_small_buckets_repeats_and_nulls(spark):
    rows = [(i, "é" * (i % 50)) for i in range(600)] + [(5, None)] * 3 + [(7, "same")] * 400 + [(None, "x"), (None, None)]
    out = sharding.shard_rows(frame(spark, rows), 4, bucket_bytes=500)
    got = out.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    check(got, 4)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shard_rows(frame(spark, rows), 4, bucket_bytes=500).collect()), key=str)
    by_slot = [r.doc_id for r in sorted((r for r in got if r.shard == 0 and r.doc_id is not None), key=lambda r: r.slot)]
    assert by_slot != sorted(by_slot)


def test_empty_and_written_shards(spark, tmp_path):
    assert sharding.shard_rows(frame(spark, [])).count() == 0
    sharding.write_shards(frame(spark, [(i, str(i)) for i in range(100)]), f"file://{tmp_path}/out", 3, bucket_bytes=200)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.select("row.*").count() == 100
    assert back.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap")).filter("gap <> 0").count() == 0


def test_query_writes_whole_records(spark, sf_dir):
    out = sharding.op3_sharding(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = out.inputFiles()[0].split("/shard=")[0]
    back = spark.read.parquet(folder)
    assert sorted(map(tuple, back.select("row.*").collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    where = {(r.doc_id, r.shard, r.slot) for r in out.collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.select("row.doc_id", "shard", "slot").collect()} == where


def test_written_copies_spread_over_buckets(spark, tmp_path, monkeypatch):
    seen, real = [], sharding.shuffle_buckets
    monkeypatch.setattr(sharding, "shuffle_buckets", lambda df, *a: seen.append(df) or real(df, *a))
    rows = [(7, "same")] * 2500 + [(i, str(i)) for i in range(500)]
    sharding.write_shards(frame(spark, rows), f"file://{tmp_path}/out", 3, bucket_bytes=1000)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert Counter(map(tuple, back.select("row.doc_id", "row.text").collect())) == Counter(rows)
    largest = seen[0].filter("row.doc_id = 7").groupBy("shard", "bucket").count().agg(F.max("count")).first()[0]
    assert largest < 2500 / 4


def test_slots_are_the_same_at_any_number_of_shuffle_partitions(spark):
    rows = [(i, "é" * (i % 50)) for i in range(900)] + [(7, "same")] * 300
    key, got = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    for n in ("3", "7"):
        spark.conf.set(key, n)
        got.append(sorted(map(tuple, sharding.shard_rows(frame(spark, rows), 5, bucket_bytes=700).collect())))
    spark.conf.set(key, before)
    assert got[0] == got[1]


def test_maps_are_written(spark, tmp_path):
    rows = [(i, str(i), {"a": i, "b": 2}) for i in range(40)] + [(3, "3", {"a": 3, "b": 2})] * 2 + [(50, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    sharding.write_shards(df, f"file://{tmp_path}/out", 3, bucket_bytes=100)
    back = spark.read.parquet(f"file://{tmp_path}/out").select("row.*")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.dtypes == df.dtypes
