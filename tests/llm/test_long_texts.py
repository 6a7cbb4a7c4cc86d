"""Very long and repetitive texts: bounded time, and what plain versions give on shorter ones."""

import random
import time

import numpy as np
import public_tokenizers
import sentencepiece

from geoloom.llm import decontaminate as dc
from geoloom.llm import langid, secrets, sentencepieces
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_secrets import brute as spans

PATH = public_tokenizers.path("piece_bpe_32k.model")


def seconds(f):
    began = time.perf_counter()
    out = f()
    return out, time.perf_counter() - began


def test_runs_of_spaces():
    codec, library = sentencepieces.Codec(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for n in (2, 15, 16, 17, 31, 33, 1000, 4001):
        for t in (" " * n, "a" + " " * n, " " * n + "word", "x" + " " * n + "\n" + " " * n + "y"):
            assert codec.encode(t) == library.encode(t), n
    ids, took = seconds(lambda: codec.encode_bytes(" " * 5_000_000))
    assert took < 10 and codec.decode(np.frombuffer(ids, np.int32).tolist()) == " " * 5_000_000


def test_repeats_against_a_repeated_item():
    cases = [("word " * 40, "word " * 12), ("a b " * 60, "a b " * 20), ("a b c " * 30 + "x y z", "c a b " * 9), ("word " * 30 + "other " + "word " * 30, "word " * 9 + "it " + "word " * 9)]
    for text, item in cases:
        found = list(dc.Index([(1, item)]).overlaps(["no such words", text]))
        assert [f[:2] for f in found] == ([(1, 1)] if overlaps(text, item)[0] else [])
    dc_hits, dc_many = dc.HITS, dc.MANY_HITS
    rng = random.Random(2)
    for _ in range(40):  # the same diagonals, whichever way they are found
        words = np.array(rng.choices(range(1, rng.choice([2, 3, 5])), k=80), np.uint64)
        index = dc.Index([(k, " ".join(f"w{x}" for x in rng.choices(range(1, 4), k=25))) for k in range(3)])
        words = np.concatenate([index.words[0][:20], words, index.words[-1], index.words[-1][:9]])
        bounds = np.array([0, 50, len(words)])
        ways = []
        for dc.HITS, dc.MANY_HITS in ((1 << 21, 1 << 40), (7, 1 << 40), (1 << 21, 1)):
            ways.append(index.diagonals(words, bounds).tolist())
        dc.HITS, dc.MANY_HITS = dc_hits, dc_many
        assert ways[0] == ways[1] == ways[2] and ways[0]
    index = dc.Index([(1, "word " * 1000), (2, "word " * 500 + "other " + "word " * 499)])
    found, took = seconds(lambda: list(index.overlaps(["word " * 1_000_000])))
    assert took < 20 and [(f[1], f[2][0]) for f in found] == [(1, 1000), (2, 999)]


def test_items_of_few_words_are_sought():
    index = dc.Index([(1, "one"), (2, "Two words"), (3, "and three words"), (4, "these are four words"), (5, "")])
    found = {(d, i) for d, i, _ in index.overlaps(["one", "two, words; and three words", "these are four words", "nothing here", None])}
    assert found == {(0, 1), (1, 2), (1, 3), (2, 4)}


def test_recall_of_substituted_items():
    """Of items of 40 words with a word in ten replaced at random, at least 0.95 are found; one in six: 0.8."""
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(5000)]
    items = [(k, rng.choices(vocab, k=40)) for k in range(200)]
    index = dc.Index([(k, " ".join(w)) for k, w in items])
    for share, least in ((0.1, 0.95), (1 / 6, 0.8)):
        texts = []
        for _, w in items:
            w = [rng.choice(vocab) if rng.random() < share else x for x in w]
            texts.append(" ".join(rng.choices(vocab, k=50) + w + rng.choices(vocab, k=50)))
        agree = [sum(a == b for a, b in zip(t.split()[50:90], w)) >= 32 for t, (_, w) in zip(texts, items)]
        found = {(d, k) for d, k, _ in index.overlaps(texts)}
        assert sum((k, k) in found for k, ok in enumerate(agree) if ok) / sum(agree) >= least, share


def test_many_secrets_in_one_text(spark):
    rng = random.Random(4)
    made = lambda n: " ".join(rng.choice(["deadbeef" * 2, "x", "é😀", "AKIA" + "B" * 16, "secret=" + "q" * 14, "token=ab", "0123456789abcdef01", "\n"]) for _ in range(n))
    rows = [(n, made(n)) for n in (0, 1, 2, 3, 4, 5, 9, 10, 100, 3000)]
    found, _ = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()} == {n: spans(t) for n, t in rows}
    df = spark.createDataFrame([(1, "0123456789abcdef " * 300_000)], "doc_id long, text string")
    out, took = seconds(lambda: secrets.scan(df)[0].selectExpr("size(spans) as n", "spans[299999].end as last").first())
    assert took < 20 and (out.n, out.last) == (300_000, 300_000 * 17 - 1)


def test_a_scanned_blob_is_not_scanned_again(spark):
    """Two versions of a table: every blob is in the ledger once, and the second scan adds the new ones only."""
    one = spark.createDataFrame([(k, f"token=abcdefghijkl{k % 7}") for k in range(40)], "doc_id long, text string")
    two = spark.createDataFrame([(k, f"token=abcdefghijkl{k % 9}") for k in range(40)], "doc_id long, text string")
    _, first = secrets.scan(one)
    _, second = secrets.scan(two, first)
    assert (first.count(), second.count(), second.select("blob").distinct().count()) == (7, 9, 9)
    _, third = secrets.scan(two, second)
    assert third.count() == 9


def test_what_is_a_letter():
    for t in ("²½", "Ⅻ ①", "١٢٣", "𝟘𐄇 ௰", "_ _", "12 ½"):
        assert not langid.normalise(t).strip(), t
    for t in ("ª", "日", "𐐀", "ß²", "a½"):
        assert langid.normalise(t).strip(), t
    assert langid.Classifier({"de": b"der die das"}).predict("²½")[:2] == ("und", 0.0)


def test_languages_against_plain_compression(spark, sf_dir):
    """Choice and score of every whole text, from sizes that are found the plain way."""
    import re
    import unicodedata

    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.identify(docs, dictionaries).collect()}
    for d in docs.collect():
        letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (d.text or "").lower())
        plain = re.sub(" +", " ", letters).strip()
        r = rows[d.doc_id]
        if not plain:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        sizes = []
        for lang, data in sorted(dictionaries.items()):
            shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=langid.LEVEL)
            packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(packer.compress(plain[k : k + langid.BLOCK_CHARS].encode())) for k in range(0, len(plain), langid.BLOCK_CHARS)), lang))
        sizes.sort()
        assert r.lang_pred == sizes[0][1]
        lead = sizes[1][0] - sizes[0][0]
        assert r.score in (0.5, 1.0 - 0.5 * 2.0 ** -min(lead, 60))
        assert r.score == 0.5 or abs(r.margin - 8 * lead / len(plain)) < 1e-9
        assert not (lead == 0 and not r.rejected)
