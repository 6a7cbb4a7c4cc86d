import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoloom.operators import network
from geoloom.operators.components import connected_components


def frame(spark, rows):
    return spark.createDataFrame(rows, "fid long, u long, v long, len double")


def reach(rows, start):
    near = defaultdict(set)
    for _, u, v, *_ in rows:
        near[u].add(v)
        near[v].add(u)
    seen, todo = {start}, [start]
    while todo:
        for x in near[todo.pop()] - seen:
            seen.add(x)
            todo.append(x)
    return seen


def brute_bridges(rows):
    return sorted(f for f, u, v, *_ in rows if u != v and v not in reach([r for r in rows if r[0] != f], u))


def random_network(seed, n_edges=70, n_nodes=55):
    rng = random.Random(seed)
    return [(i, rng.randrange(n_nodes), rng.randrange(n_nodes), rng.random() * 100) for i in range(n_edges)]


def test_degrees_and_codes(spark):
    rows = [(1, 1, 2, 5.0), (2, 2, 3, 50.0), (3, 4, 5, 5.0), (4, 6, 6, 5.0), (5, 7, 8, None), (6, None, 2, 1.0)]
    got = {r.fid: (r.s_deg, r.e_deg, r.code) for r in network.dangle_prune(frame(spark, rows)).collect()}
    assert got == {1: (0, 1, "SHORT_DANGLE"), 2: (1, 0, "LONG_DANGLE_KEEP"), 3: (0, 0, "SHORT_ISOLATED"), 4: (0, 0, "SHORT_ISOLATED")}


def test_bridges_of_the_hand_made_network(spark):
    rows = [(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 3, 4), (5, 4, 5), (6, 4, 5), (7, 5, 6), (8, 6, 6)]
    df = frame(spark, [(*r, 1.0) for r in rows])
    assert sorted(r.fid for r in network.bridges(df).collect()) == [4, 7]
    codes = {r.fid: r.code for r in network.loop_purge(df).collect()}
    assert codes == {1: "CYCLE_EDGE", 2: "CYCLE_EDGE", 3: "CYCLE_EDGE", 4: "BRIDGE_KEEP", 5: "CYCLE_EDGE", 6: "CYCLE_EDGE", 7: "BRIDGE_KEEP", 8: "SELF_LOOP"}


@pytest.mark.parametrize("most_edges", [1_000_000, 0])
def test_bridges_equal_brute_force(spark, most_edges):
    rows = random_network(3)
    assert sorted(r.fid for r in network.bridges(frame(spark, rows), most_edges).collect()) == brute_bridges(rows)


def test_walk_equals_brute_force_on_many():
    for seed in range(150):
        rows = random_network(seed, 40, 32)
        assert sorted(network.bridges_of(*zip(*[(f, u, v) for f, u, v, _ in rows]))) == brute_bridges(rows)


def test_cleanup_chain(spark):
    rows = random_network(8, 60, 60)

    def prune(rows):
        at = defaultdict(set)
        for f, u, v, _ in rows:
            at[u].add(f)
            at[v].add(f)
        return [r for r in rows if min(len(at[r[1]]), len(at[r[2]])) > 1 or r[3] > 40]

    want = prune(rows)
    ok = set(brute_bridges(want))
    want = prune([r for r in want if r[0] in ok])
    assert sorted(map(tuple, network.cleanup(frame(spark, rows), 40).collect())) == sorted(want)


def test_components(spark):
    rows = random_network(5, 45, 60) + [(1000 + i, 100 + i, 101 + i, 0.0) for i in range(40)]
    df = connected_components(frame(spark, rows).select(F.col("u").alias("a"), F.col("v").alias("b")))
    got = {r.node: r.root for r in df.collect()}
    assert df.count() == len(got)
    for _, u, v, _ in rows:
        if u != v:
            assert got[u] == got[v] == min(reach(rows, u))


def test_independent_set_is_greedy_and_not_transitive(spark):
    rng = random.Random(1)
    for n, pairs in ((3, {(1, 2), (2, 3)}), (40, {(rng.randrange(40), rng.randrange(40)) for _ in range(60)})):
        nodes = [(i, float((i * 7) % 11) if n > 3 else float(i)) for i in range(n + 1)]
        kept, base = [], {}
        for i, _ in sorted(nodes, key=lambda x: (x[1], x[0])):
            hits = [k for k in kept if (i, k) in pairs or (k, i) in pairs]
            base[i] = hits[0] if hits else i
            if not hits:
                kept.append(i)
        df = network.independent_set(spark.createDataFrame(nodes, "id long, rank double"), spark.createDataFrame(sorted(pairs), "a long, b long"))
        assert {r.id: (r.kept, r.base) for r in df.collect()} == {i: (base[i] == i, base[i]) for i, _ in nodes}


def test_components_that_have_not_converged_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="not converged"):
        connected_components(chain, most_rounds=2)
    assert {r.root for r in connected_components(chain).collect()} == {0}


def test_few_tables_for_rings_and_chains(spark, monkeypatch):
    """Scratch tables of a ring's bridges and of a chain of conflicts, short and long."""
    made = []
    real = network.stored
    monkeypatch.setattr(network, "stored", lambda df, name: made.append(name) or real(df, name))
    counts = []
    for n in (40, 4000):
        made.clear()
        ring = spark.createDataFrame([(i, i, (i + 1) % n, 1.0) for i in range(n)] + [(n, 0, n, 1.0)], "fid long, u long, v long, len double")
        assert [r.fid for r in network.bridges(ring).collect()] == [n]
        chain = network.independent_set(spark.createDataFrame([(i, float(i)) for i in range(n)], "id long, rank double"), spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long"))
        assert sorted(r.id for r in chain.filter("kept").collect()) == list(range(0, n, 2))
        counts.append(len(made))
    assert counts[1] <= 4 * max(1, counts[0])


def test_rounds_equal_the_walk(spark):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(i, float(rng.randrange(9))) for i in range(30)], "id long, rank double")
    pairs = spark.createDataFrame(sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(45)}), "a long, b long")
    walked, rounds = (sorted(map(tuple, network.independent_set(nodes, pairs, most).collect())) for most in (10**6, 2))
    assert walked == rounds
