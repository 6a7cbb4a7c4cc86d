import zlib

import numpy as np
import pytest

from geoloom.llm import quality


def brute(data, table):
    """Every window by itself."""
    x = list(data)
    n = quality.windows(len(x))
    x += [256] * ((n - 1) * quality.STRIDE + quality.WIDTH - len(x))
    z = np.array([sum(table[k, x[s * quality.STRIDE + k]] for k in range(quality.WIDTH)) for s in range(n)])
    return z.max(axis=0)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 12, 13, 500, 65_535, 65_536, 65_537, 65_540, 131_070])
def test_chunks_equal_one_convolution(n):
    rng = np.random.default_rng(n)
    table = rng.normal(size=(quality.WIDTH, 257, 2)).astype(np.float32)
    data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
    top, at = quality.pooled(data, table)
    assert np.allclose(top, brute(data, table), atol=1e-4)
    assert (at < quality.windows(n)).all()


def test_pattern_far_down_a_long_text_counts():
    rng = np.random.default_rng(0)
    words = [b"alpha", b"beta", b"gamma", b"delta"]
    clean = [b" ".join(words[k] for k in rng.integers(0, 4, 60)) for _ in range(150)]
    junk = [t[:100] + b" $$$%%%$$$ " + t[100:] for t in clean]
    net = quality.fit(clean + junk, [1] * 150 + [0] * 150, epochs=8)
    long = b" ".join(clean)
    assert net.score(long) > 0.5 > net.score(long + b" $$$%%%$$$ " + clean[0])


def test_nulls_and_missing_classes(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x" * 10, 0), (2, "", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    net = quality.fit(*quality.training_rows(docs, labels))
    got = quality.score_documents(docs, net).collect()
    assert len(got) == 4 and all(abs(r.score - 0.5) < 1e-9 for r in got)
    assert quality.fit([b"a"], [1]).score(b"zz") > 0.9
    assert quality.score_documents(docs.limit(0), net).count() == 0


def test_held_out_ranking(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")  # smaller tables have too few labels 0 to judge by
    rows = quality.op7_quality_classifier(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(rows) == docs and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 1]
    bad = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_no_byte_in_front_hides_a_window():
    rng = np.random.default_rng(3)
    table = rng.normal(size=(quality.WIDTH, 257, 4)).astype(np.float32)
    data = rng.integers(0, 256, 700, dtype=np.uint8).tobytes()
    top, _ = quality.pooled(data, table)
    for n in (1, 2, 3, 5):
        assert (quality.pooled(b"x" * n + data, table)[0] >= top - 1e-4).all()


def test_training_sees_all_parts_of_long_texts(spark):
    docs = spark.createDataFrame([(i, "a" * 30_000 + "b" * 30_000) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    texts, _, whole = quality.training_rows(docs, labels)
    assert any(b"b" not in t for t in texts) and any(b"a" not in t for t in texts)
    assert 0 < sum(whole) < len(whole) and all(len(t) == (60_000 if w else quality.PART_BYTES) for t, w in zip(texts, whole))
    clean = [b"alpha beta gamma " * 300] * 30
    marked = [t[:4500] + b" $$$%%%$$$ " + t[4500:] for t in clean]
    net = quality.fit(clean + marked, [1] * 30 + [0] * 30, [True] * 60, epochs=8)
    assert net.score(clean[0]) > 0.5 > net.score(marked[0])
