import random
import re

from geoloom.llm import decontaminate as dc
from geoloom.llm import wordhash

CUT = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return CUT.findall((text or "").lower())


def brute(text, item):
    """Whether any overlay of the item verifies, and the most words that agree in one."""
    d, w, found, most = words(text), words(item), False, 0
    for begin in range(-len(w) + 1, len(d)):
        same = [begin + k < len(d) and begin + k >= 0 and d[begin + k] == x for k, x in enumerate(w)]
        most = max(most, sum(same))
        found |= sum(same) >= 0.8 * len(w)
        for i in range(len(w)):
            for j in range(i + 12, len(w) + 1):
                hits = sum(same[i:j])
                found |= hits >= 12 and hits - 4 * (j - i - hits) == max_score(same)
    return found, most


def max_score(same):
    best = run = 0
    for x in same:
        run = max(0, run + (1 if x else -4))
        best = max(best, run)
    return best


def test_word_hashes():
    texts = [b"", b"  ", b"One two\tone\x0btwo", "é É 日本".encode(), b"x" * 3000, b"one"]
    seen = {}
    for first, w, bounds in wordhash.word_groups(texts):
        for k, t in enumerate(texts[first:]):
            found = w[bounds[k] : bounds[k + 1]].tolist()
            assert len(found) == len(t.split())
            for h, word in zip(found, t.split()):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([5, 6, 7, 9, 20, 45])))) for k in range(25)] + [(90, None), (91, ""), (92, "a b"), (93, "Only, FIVE short words: here!")]
    items.append((94, items[4][1]))
    docs = []
    for k in range(60):
        t = rng.choices(vocab, k=rng.randint(0, 90))
        if k % 3 == 0:
            w = items[k % 25][1].split()
            if k % 2:
                for j in range(4, len(w), 7):
                    w[j] = "SUBST"
            at = rng.randint(0, len(t))
            t[at:at] = w
        docs.append((k, " ".join(t)))
    docs += [(200, None), (201, ""), (202, "x only five SHORT words here y"), (203, items[0][1]), (203, items[0][1])]
    want = []
    for d, t in docs:
        for i, w in items:
            if len(words(w)) >= 5 and set(words(t)) & set(words(w)):
                found, most = brute(t, w)
                if found and (len(words(w)) >= 8 or most == len(words(w))):
                    want.append((d, i))
    want.sort()
    ddf = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bdf = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = dc.find_overlaps(ddf, bdf).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == want and len(want) > 15
    for r in got:
        d, w = words(dict(docs)[r.doc_id])[r.doc_word :], words(dict(items)[r.item_id])[r.item_word :]
        n = r.matches + r.substitutions
        assert sum(a == b for a, b in zip(d[:n], w[:n])) == r.matches
    assert sorted((r.doc_id, r.item_id) for r in dc.find_overlaps(ddf, bdf, block_bytes=300).collect()) == want
    kept = dc.drop_contaminated(ddf, bdf, block_bytes=900)
    assert kept.columns == ddf.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {x for x, _ in want})
    assert dc.find_overlaps(ddf.limit(0), bdf).count() == dc.find_overlaps(ddf, bdf.limit(0)).count() == 0


def test_query_over_whole_table(spark, sf_dir):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {d.item_id: d.text for d in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in dc.op9_benchmark_decontamination(spark, sf_dir).collect()}
    verbatim = {(d, i) for d, t in docs.items() for i, w in items.items() if " ".join(words(w)) in " ".join(words(t)) and len(words(w)) >= 5}
    assert verbatim and verbatim <= got
    assert all(len(set(words(docs[d])) & set(words(items[i]))) >= 5 for d, i in got)
