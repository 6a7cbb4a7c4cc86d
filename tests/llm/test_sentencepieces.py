import random
import zlib

import public_tokenizers
import pytest
import sentencepiece

from geoloom.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", " a", "   a b  c    d", "a  ", "\n", "\n\n a\n  b", "▁", "a▁b", "▁▁ x", "日本語 テスト", "é✓😀", "<s> </s> <unk> <0x41>", "x" * 500, "=" * 777, " " * 300 + "y", "ab" * 300 + "日" * 40 + "cd" * 100, "\r\n \r\n", "\0a", "İıß ǅ"]


@pytest.fixture(scope="module")
def both():
    model = open(PATH, "rb").read()
    return sentencepieces.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def random_texts(n):
    rng = random.Random(5)
    kinds = ["ab ", "etaoinshrdlu ", "  ab", "the ing er ", "=-_*/", "éèñü ", "0123 ", "\n ab", "aA "]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 120))) for _ in range(n)]


def test_ids_and_text_equal_the_library(both):
    codec, library = both
    for t in TEXTS + random_texts(1500):
        ids = library.encode(t)
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == library.decode(ids), t


def test_paths_are_committed_early(both):
    codec, library = both
    live = []
    commit = codec._commit

    def watched(back, size, out):
        moved = commit(back, size, out)
        live.append(len(back))
        return moved

    codec._commit = watched
    t = "thequickbrownfoxjumpsoverthelazydog" * 400
    assert codec.encode(t) == library.encode(t)
    assert len(live) > 50 and max(live) < 4 * sentencepieces.WINDOW
    codec._commit = commit


def test_small_cache(both):
    codec = sentencepieces.Codec(open(PATH, "rb").read(), entries=2)
    for t in TEXTS * 2:
        assert codec.encode(t) == both[1].encode(t)


def test_frames(spark, both):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, None, "x"), (None, "a b", "y"), (3, " a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sentencepieces.encode_documents(df, PATH)
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == sorted((str(i), both[1].encode(t or "")) for i, t, _ in rows)
    back = {(r.doc_id, r.text) for r in sentencepieces.decode_documents(got, PATH).collect()}
    assert back == {(i, (t or "").replace("▁", " ")) for i, t, _ in rows}
    assert sentencepieces.encode_documents(df.limit(0), PATH).count() == 0


def test_query_over_whole_table(spark, sf_dir, both):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sentencepieces.op2_sentencepiece(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.ids == both[1].encode(docs[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert r.lossless and r.decoded_crc32 == zlib.crc32((docs[r.doc_id] or "").encode())
