import public_tokenizers

from geoloom.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "\n\n  \t x", "a<|endoftext|>b <|endoftext|><|endoftext|>", "don't we'll it'S", "é✓😀 日本語    x", "x" * 30_000, "12345 67 ٣", "\x1c\x1d \x85", " " * 5000 + "y", "<|endoftext", "tout à coup\r\n", "Zu und. Dieüauß der."]


def expected(texts):
    t = tokencount.load_tokenizer(open(PATH, encoding="utf-8").read())
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_counts_equal_the_library(spark):
    rows = [(i, t, -1) for i, t in enumerate(TEXTS)] + [(1, "again", -1)] * 2 + [(None, "no id", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = tokencount.count_tokens(df, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_bytes) for r in got) == sorted((str(i), n, len((t or "").encode())) for (i, t, _), n in zip(rows, expected([r[1] for r in rows])))
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokencount.count_tokens(df.limit(0), PATH).count() == 0


def test_small_cache_gives_the_same():
    definition = open(PATH, encoding="utf-8").read()
    c = tokencount.Counter(definition, {}, entries=3)
    for _ in range(3):
        assert c.count(TEXTS) == expected(TEXTS)


def test_query_over_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in tokencount.op1_token_counts(spark, sf_dir).collect()}
    assert [got[d.doc_id] for d in docs] == expected([d.text for d in docs])


def test_other_kinds_of_tokenizer_are_refused():
    import pytest

    with pytest.raises(ValueError):
        tokencount.load_tokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
