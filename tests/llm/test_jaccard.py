import random
import re

import numpy as np
import pytest

from geoloom.llm import jaccard

CUT = re.compile(r"[^\x20\x09-\x0d]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text, k):
    w = CUT.findall((text or "").translate(UPPER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    """(id, size, component) by all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus(seed, n_groups=14):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(5000)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for g in range(n_groups):
        base = rng.choices(vocab, k=rng.choice([3, 6, 11, 14, 19, 21, 24, 30, 55, 120, 300]))
        for _ in range(rng.randint(1, 7)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t + (passage if g % 4 == 0 else [])))
    texts += ["", "one", "One", "one two", "ONE\ttwo", "É é", "é é", None]
    return list(enumerate(texts, 10))


def run(spark, rows, k, percent):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    return sorted(((r.doc_id, r.n, r.component) for r in jaccard.link_components(df, k, percent).collect()), key=str)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    plan, rng = jaccard.Plan(percent), np.random.default_rng(percent)
    assert 0 < plan.light < plan.HORIZON
    linked = 0
    for n in [*range(1, 64), 90, 150, 400, 3000]:
        for _ in range(3):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            for gone, new in ((0, 0), (1, 0), (0, 1), (1, 1), (n // 20, n // 20), (n // 10, 0), (0, n // 9), (n // 5, 0), (n // 10, n // 10)):
                b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - gone], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
                    linked += 1
                    (ka, na), (kb, nb) = plan.keys(a), plan.keys(b)
                    assert np.intersect1d(ka, kb).size >= max(na, nb) >= 1, (n, gone, new)
    assert linked > 300


def test_components_equal_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_other_parameters_repeats_and_null_ids(spark):
    rows = corpus(2, 8) + [(12, "again and again and again"), (12, corpus(2, 8)[3][1]), (None, corpus(2, 8)[3][1]), (None, None)]
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_groups_of_near_copies_without_all_pairs_and_chains(spark):
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(3000)]
    base = rng.choices(vocab, k=150)
    rows = []
    for i in range(60):  # each two words from the base, mostly too far from each other
        t = list(base)
        for _ in range(2):
            t[rng.randrange(150)] = f"new{rng.random()}"
        rows.append((i, " ".join(t)))
    rows.append((500, " ".join(base)))
    t = rng.choices(vocab, k=200)
    for i in range(600, 625):  # a chain, whose ends are far apart
        t = list(t)
        t[(i * 7) % 200] = f"step{i}"
        rows.append((i, " ".join(t)))
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_an_id_with_many_texts_does_not_mix_them(spark):
    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(3000)]
    rows = []
    for g in range(12):
        base = rng.choices(vocab, k=60)
        near = list(base)
        near[30] = "changed"
        rows += [(7, " ".join(base)), (100 + g, " ".join(near)), (100 + g, " ".join(near))]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_empty_and_kept(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert jaccard.link_components(df).count() == 0
    rows = corpus(3, 6)
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], df.schema)
    kept = jaccard.keep_one_of_each_group(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in brute(rows, 5, 80) if i == c)


def test_runs_pass_every_row_whose_key_has_two_nodes():
    import pyarrow as pa

    rng = random.Random(6)
    for size in (1, 3, 7, 100):
        rows = sorted((rng.randrange(60), rng.randrange(8)) for _ in range(90))
        tables = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64()), pa.array([1] * len(part), pa.int32())], ["key", "node", "need"]) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        got = [(k, n) for b in jaccard._in_runs(iter(tables)) for k, n in zip(b.column("key").to_pylist(), b.column("node").to_pylist())]
        nodes = {}
        for k, n in rows:
            nodes.setdefault(k, set()).add(n)
        want = {(k, n) for k, n in rows if len(nodes[k]) > 1}
        ends = {r for r in rows if r[0] in (rows[0][0], rows[-1][0])}
        assert want <= set(got) <= want | ends and len(got) == len(set(got))
    assert list(jaccard._in_runs(iter([]))) == []


def test_only_the_linked_text_of_an_id_goes(spark):
    vocab = [f"w{k}" for k in range(400)]
    one, two = " ".join(vocab[:80]), " ".join(vocab[100:180])
    rows = [(3, one), (7, one + " end"), (7, two), (7, two), (7, None), (9, two + " end"), (None, one), (11, "alone")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = jaccard.keep_one_of_each_group(df)
    want = [(3, one), (7, two), (7, two), (7, None), (None, one), (11, "alone")]
    assert sorted(((r.doc_id, r.text) for r in kept.select(*df.columns).collect()), key=str) == sorted(want, key=str)
