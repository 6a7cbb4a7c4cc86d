"""The stages against plain versions, each on its own input."""

import duckdb
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from geoloom.llm import langid, linededup  # noqa: E402
from tests.llm.test_decontaminate import brute as overlaps  # noqa: E402
from tests.llm.test_decontaminate import words  # noqa: E402
from tests.llm.test_jaccard import brute as components  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Every stage's rows, written and read again like the driver does."""
    from geoloom.session import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), name))
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_copies", "decontamination", "sentencepieces"]
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_language_stage(steps):
    before, after = steps[0].collect(), steps[1].collect()
    classify = langid.Classifier(langid.fit(steps[0])).predict
    want = {d.doc_id for d in before for lang, _, m in [classify(d.text)] if lang != "und" and m >= langid.MARGIN}
    assert {d.doc_id for d in after} == want and len(want) > 0.9 * len(before)


def test_line_stage(steps):
    rows = steps[1].collect()
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([{"doc_id": r.doc_id, "text": r.text} for r in rows]))
    want = {i: t for i, n, gone, t in con.execute(linededup.SQL["op6_line_dedup"]).fetchall() if not gone or t.strip()}
    got = {r.doc_id: r for r in steps[2].collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_copy_stage(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    want = {i for i, _, c in components(rows, 5, 80) if i == c}
    assert {r.doc_id for r in steps[3].collect()} == want


def test_benchmark_stage(spark, sf_dir, steps):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 4]) for t in items for w in [words(t)] for k in range(len(w) - 3)}
    kept = {r.doc_id for r in steps[4].collect()}
    for r in steps[3].collect():
        w = words(r.text)
        near = any(tuple(w[k : k + 4]) in grams for k in range(len(w) - 3))
        hit = near and any(overlaps(r.text, t)[0] for t in items)
        assert (r.doc_id in kept) == (not hit)


def test_piece_stage(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    got = {r.doc_id: r.ids for r in steps[5].collect()}
    assert got == {i: library.encode(t) for i, t in texts.items()}


def test_run_gives_the_last_stage(spark, sf_dir, steps):
    a, b = corpus_pipeline.run(spark, sf_dir), steps[-1]
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_edges(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (3, "the river and the house", "en", "s", 23), (3, "the river and the house", "en", "s", 23), (None, "le fleuve et la maison", "fr", "s", 22)]
    for data in (rows, []):
        df = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
        assert df.count() == (3 if data else 0)
