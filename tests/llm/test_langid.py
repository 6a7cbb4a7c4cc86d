import random
import zlib

from geoloom.llm import langid

WORDS = {"en": "the of and house river under there with people water", "de": "der die und haus fluss unter dort mit leute wasser", "fr": "le la et maison rivière sous là avec gens eau"}


def corpus(n=30):
    rows = []
    for k, (lang, words) in enumerate(sorted(WORDS.items())):
        w = words.split()
        rows += [(1000 * k + i, " ".join(w[(i * j + j) % len(w)] for j in range(40)), lang) for i in range(n)]
    return rows


def test_edges_and_rejections(spark):
    train = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    dictionaries = langid.fit(train)
    assert sorted(dictionaries) == sorted(WORDS)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "THE RIVER, THE HOUSE & the people under water" * 300), (5, "der fluss und die leute dort"), (5, "der fluss und die leute dort"), (None, "la rivière et la maison avec les gens"), (7, "zzqqxx")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = sorted(map(tuple, langid.identify(df, dictionaries).collect()), key=lambda r: (str(r[0]), r[1]))
    by = {r[0]: r for r in got}
    assert [by[k][1:3] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and all(by[k][4] for k in (1, 2, 3, 7))
    assert (by[4][1], by[5][1], by[None][1]) == ("en", "de", "fr") and not by[4][4]
    assert len(got) == len(rows) and all(0 <= r[2] <= 1 for r in got)
    kept = langid.drop_rejected(df, dictionaries).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in got if not r[4])
    assert langid.identify(df.limit(0), dictionaries).count() == 0


def test_no_labels_and_one_language(spark):
    none = spark.createDataFrame([(3, "the house", None)], "doc_id long, text string, lang string")
    assert langid.fit(none) == {}
    assert langid.identify(none, {}).first().lang_pred == "und"
    assert langid.identify(none, {"en": b"the house"}).first()[1:3] == ("en", 1.0)


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = langid.op4_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.96


def test_junk_of_several_lengths_is_rejected(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = langid.Classifier(langid.fit(docs))
    pick = random.Random(5)
    syllables = [a + b for a in "bcdfghjklmnpqrstvwz" for b in "aeiou"]
    words = ["".join(pick.choices(syllables, k=pick.randint(1, 4))) for _ in range(2000)]
    for n in (100, 200, 400, 1000, 3000):
        letters = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for _ in range(40)]
        unlearned = [" ".join(pick.choices(words, k=n))[:n] for _ in range(40)]
        for texts in (letters, unlearned):
            assert sum(c.predict(t)[2] < langid.MARGIN for t in texts) >= 38, n
    held = [d for d in docs.filter(langid.held_out(docs.doc_id) & docs.text.isNotNull()).collect()]
    right = [c.predict(d.text)[2] >= langid.MARGIN for d in held]
    assert sum(right) / len(right) > 0.95
