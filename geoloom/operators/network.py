"""Line-network operators on edges (fid, u, v, len): pruning of dangling lines and of loops."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.components import connected_components
from geoloom.operators.labels import global_rank
from geoloom.session import free, stored


def node_degrees(edges: DataFrame) -> DataFrame:
    """node, deg: distinct edges at each node (a loop counts once)."""
    ends = edges.select("fid", F.col("u").alias("node")).union(edges.select("fid", F.col("v").alias("node")))
    return ends.filter("node is not null").groupBy("node").agg(F.countDistinct("fid").alias("deg"))


def dangle_prune(edges: DataFrame, short_len: float = 20, isolated_len: float = 20) -> DataFrame:
    """Adds s_deg, e_deg (other edges at either end), code and removed.

    Edges without a node or a length belong to neither output and are left out.
    Degrees are those of the input, thresholds are inclusive, and one pass is made.
    """
    whole = edges.filter("u is not null and v is not null and len is not null")
    deg = node_degrees(whole)
    out = whole.join(deg.select(F.col("node").alias("u"), (F.col("deg") - 1).alias("s_deg")), "u")
    out = out.join(deg.select(F.col("node").alias("v"), (F.col("deg") - 1).alias("e_deg")), "v")
    both, none = (F.col("s_deg") > 0) & (F.col("e_deg") > 0), (F.col("s_deg") == 0) & (F.col("e_deg") == 0)
    code = (
        F.when(both, "NORMAL_KEEP")
        .when(none & (F.col("len") <= isolated_len), "SHORT_ISOLATED")
        .when(none, "LONG_ISO_KEEP")
        .when(F.col("len") <= short_len, "SHORT_DANGLE")
        .otherwise("LONG_DANGLE_KEEP")
    )
    out = out.withColumn("code", code).withColumn("removed", F.col("code").isin("SHORT_ISOLATED", "SHORT_DANGLE").cast("int"))
    return out.select(*edges.columns, "s_deg", "e_deg", "code", "removed")


def bridges_of(fid: list[int], u: list[int], v: list[int]) -> set[int]:
    """Edges whose removal parts their component: a depth-first walk with low points, without recursion.

    Edges are told apart by id, so parallel edges are cycles; loops are no bridges.
    """
    near: dict[int, list[tuple[int, int]]] = {}
    for f, a, b in zip(fid, u, v):
        if a != b:
            near.setdefault(a, []).append((b, f))
            near.setdefault(b, []).append((a, f))
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    found = set()
    for start in near:
        if start in order:
            continue
        order[start] = low[start] = len(order)
        stack = [(start, None, iter(near[start]))]
        while stack:
            node, by, rest = stack[-1]
            for other, f in rest:
                if f == by:
                    continue
                if other in order:
                    low[node] = min(low[node], order[other])
                else:
                    order[other] = low[other] = len(order)
                    stack.append((other, f, iter(near[other])))
                    break
            else:
                stack.pop()
                if stack:
                    above = stack[-1][0]
                    low[above] = min(low[above], low[node])
                    if low[node] > order[above]:
                        found.add(by)
    return found


def strip_leaves(edges: DataFrame, most_rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(edges that hang on a node of one edge, the rest): the former are bridges.

    Most of a network of trees goes here, in parallel, before any component is gathered.
    """
    rest, gone = edges.filter("u <> v").select("fid", "u", "v"), None
    for _ in range(most_rounds):
        leaf = node_degrees(rest).filter("deg = 1").select("node")
        hit = rest.join(leaf.withColumnRenamed("node", "u"), "u", "left_semi").select("fid")
        hit = hit.union(rest.join(leaf.withColumnRenamed("node", "v"), "v", "left_semi").select("fid"))
        hit = stored(hit.distinct(), "leaves")
        if hit.isEmpty():
            break
        gone = hit if gone is None else gone.union(hit)
        rest = stored(rest.join(hit, "fid", "left_anti"), "core")
    return (rest.select("fid").limit(0) if gone is None else gone), rest


def bridges_by_labels(core: DataFrame, roots: DataFrame) -> DataFrame:
    """fid of the bridges of edges (fid, u, v) without loops, never gathering a component.

    Every edge outside a breadth-first forest gets a random 64-bit label; a tree
    edge's label is the exclusive or of the labels that end in its subtree, summed
    level by level from the deepest. It is 0 for bridges (and else by chance 2^-64).
    """
    both = stored(core.select("fid", F.col("u").alias("x"), F.col("v").alias("y")).union(core.select("fid", "v", "u")), "both")
    level = roots.select("root").distinct().select(F.col("root").alias("node"), F.lit(None).cast("long").alias("fid"), F.lit(None).cast("long").alias("up"))
    levels = [stored(level, "level")]
    seen = levels[0].select("node")
    while True:
        step = both.join(levels[-1].select(F.col("node").alias("x")), "x").join(seen.select(F.col("node").alias("y")), "y", "left_anti")
        step = step.groupBy("y").agg(F.min(F.struct("fid", "x")).alias("m"))
        new = stored(step.select(F.col("y").alias("node"), F.col("m.fid").alias("fid"), F.col("m.x").alias("up")), "level")
        if new.isEmpty():
            break
        levels.append(new)
        seen = stored(seen.union(new.select("node")), "seen")
    tree = levels[0].select("fid")
    for x in levels[1:]:
        tree = tree.union(x.select("fid"))
    loose = both.join(tree.filter("fid is not null"), "fid", "left_anti")
    own = stored(loose.groupBy("x").agg(F.bit_xor(F.xxhash64("fid", F.lit(97))).alias("label")).select(F.col("x").alias("node"), "label"), "labels")
    found, below = None, None
    for x in reversed(levels[1:]):
        here = own if below is None else own.union(below)
        summed = stored(x.join(here, "node", "left").groupBy("node", "fid", "up").agg(F.coalesce(F.bit_xor("label"), F.lit(0)).alias("label")), "summed")
        below = summed.groupBy("up").agg(F.bit_xor("label").alias("label")).select(F.col("up").alias("node"), "label")
        hit = summed.filter("label = 0").select("fid")
        found = hit if found is None else found.union(hit)
    return core.select("fid").limit(0) if found is None else found


def _walk_bridges(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"fid": sorted(bridges_of(part.fid.tolist(), part.u.tolist(), part.v.tolist()))}, dtype="int64")


def bridges(edges: DataFrame, most_edges: int = 1_000_000) -> DataFrame:
    """fid of every bridge of a multigraph.

    A network of up to ``most_edges`` edges is walked by one task. Of a larger
    one, leaves are stripped in parallel first; of what is left, components of up
    to ``most_edges`` edges are walked by one task each, and larger ones go
    through random labels, level by level: those are never gathered.
    """
    real = edges.filter("u is not null and v is not null and u <> v").select("fid", "u", "v")
    if real.limit(most_edges + 1).count() <= most_edges:
        return real.groupBy(F.lit(0).alias("__one")).applyInPandas(_walk_bridges, "fid long")
    gone, core = strip_leaves(real)
    core = stored(core, "core")
    roots = stored(connected_components(core.select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots")
    parts = stored(core.join(roots.withColumnRenamed("node", "u"), "u").select("root", "fid", "u", "v"), "parts")
    sizes = stored(parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    small, large = sizes.filter(F.col("n") <= most_edges).select("root"), sizes.filter(F.col("n") > most_edges).select("root")
    found = gone.union(parts.join(small, "root", "left_semi").groupBy("root").applyInPandas(_walk_bridges, "fid long"))
    if not large.isEmpty():
        found = found.union(bridges_by_labels(parts.join(large, "root", "left_semi").drop("root"), roots.join(large, "root", "left_semi")))
    return found.distinct()


def loop_purge(edges: DataFrame) -> DataFrame:
    """Adds code (SELF_LOOP, CYCLE_EDGE, BRIDGE_KEEP) and removed: every edge of every cycle goes."""
    whole = edges.filter("u is not null and v is not null")
    out = whole.join(bridges(whole).withColumn("bridge", F.lit(True)), "fid", "left")
    code = F.when(F.col("u") == F.col("v"), "SELF_LOOP").when(F.col("bridge"), "BRIDGE_KEEP").otherwise("CYCLE_EDGE")
    out = out.withColumn("code", code).withColumn("removed", (F.col("code") != "BRIDGE_KEEP").cast("int"))
    return out.select(*edges.columns, "code", "removed")


def cleanup(edges: DataFrame, length: float = 300) -> DataFrame:
    """Dangling lines, then loops, then the dangling lines that this left; the kept edges."""
    kept = edges
    for step in (lambda e: dangle_prune(e, length, length), loop_purge, lambda e: dangle_prune(e, length, length)):
        kept = stored(step(kept).filter("removed = 0").select(*edges.columns), "kept")
    return kept


def _walk_kept(part: pd.DataFrame) -> pd.DataFrame:
    """id, base of the nodes of conflicts (a, ra, b): one pass in order of (ra, a); base is the id of a kept one."""
    near: dict = {}
    for a, b in zip(part.a.tolist(), part.b.tolist()):
        near.setdefault(a, []).append(b)
    order = {a: k for k, a in enumerate(part[["ra", "a"]].drop_duplicates().sort_values(["ra", "a"]).a.tolist())}
    base: dict = {}
    for a in order:
        kept = [b for b in near[a] if base.get(b) == b]
        base[a] = min(kept, key=order.__getitem__) if kept else a
    return pd.DataFrame({"id": list(base), "base": list(base.values())}, dtype="int64")


def independent_set(nodes: DataFrame, conflicts: DataFrame, most_pairs: int = 1_000_000) -> DataFrame:
    """Greedy choice in the order of nodes (id, rank): a node is kept unless an earlier kept one conflicts with it.

    conflicts holds pairs (a, b) of ids. Up to ``most_pairs`` pairs are walked in
    order by one task; of more, the components with up to so many are, by a task
    each. Larger components go through rounds: every undecided node that is first
    among its undecided neighbours is kept and its neighbours are absorbed, with
    the outcome of one pass in order. Adds kept and base (the first kept
    neighbour, or itself).
    """
    both = conflicts.select("a", "b").union(conflicts.select("b", "a")).filter("a <> b").distinct()
    ranked = nodes.select("id", "rank")
    near = stored(both.join(ranked.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(ranked.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b"), "near")
    if near.limit(2 * most_pairs + 1).count() <= 2 * most_pairs:
        base = near.groupBy(F.lit(0).alias("__one")).applyInPandas(_walk_kept, "id long, base long")
    else:
        roots = stored(connected_components(near.filter("a < b").select("a", "b")), "roots")
        parts = stored(near.join(roots.withColumnRenamed("node", "a"), "a"), "parts")
        sizes = stored(parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
        small, large = (sizes.filter(f"n {op} {2 * most_pairs}").select("root") for op in ("<=", ">"))
        base = parts.join(small, "root", "left_semi").groupBy("root").applyInPandas(_walk_kept, "id long, base long")
        if not large.isEmpty():
            base = base.union(_kept_in_rounds(parts.join(large, "root", "left_semi").drop("root")))
    base = base.withColumnRenamed("base", "__base")
    out = nodes.join(stored(base, "base"), "id", "left").withColumn("base", F.coalesce("__base", "id"))
    return out.withColumn("kept", F.col("base") == F.col("id")).drop("__base")


def greedy_set(items: DataFrame, keys: list[str], conflicts: Callable[[DataFrame, DataFrame | None], DataFrame], most_pairs: int = 1_000_000) -> DataFrame:
    """id, base, kept of items (id, rank, ..): the choice of ``independent_set``, without making all conflicts.

    ``conflicts(some, others)`` gives the pairs (a, b) of ids that conflict: both of some if
    others is None, else b of others. Conflicts are mostly between items of equal ``keys``,
    which only foresee how many there are. If there are many, the first items in order are
    decided by themselves, then those that their kept ones absorb, and so on with what is
    left: the outcome of one pass in order. Ranks that are null or NaN come last.
    """

    def foreseen(df: DataFrame, cuts: list) -> list[int]:
        """Rows, and pairs of equal keys up to each rank (None: of all)."""
        n = [F.count(F.lit(1) if c is None else F.when(F.col("rank") <= c, 1)).alias(f"n{k}") for k, c in enumerate(cuts)]
        out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *n).agg(F.sum("n"), *[F.sum(F.col(f"n{k}").cast("decimal(38,0)") * F.col(f"n{k}") / 2) for k in range(len(cuts))]).first()
        return [int(x or 0) for x in out]

    def most(n: int) -> int:
        return max(4 * most_pairs, 16 * n)

    n, pairs = foreseen(items, [None])
    if pairs <= most(n):
        return independent_set(items.select("id", "rank"), conflicts(items, None)).select("id", "base", "kept")
    late = F.col("rank").isNull() | F.isnan(F.col("rank").cast("double"))
    left = global_rank(items.withColumn("__late", late), ["__late", "rank", "id"]).drop("__late")  # rank is 1 to n from here
    left, decided = stored(left, "left"), []
    while n:
        cut = None
        if pairs > most(n):
            shares = [0.5**k for k in range(1, max(2, (n // 1000).bit_length()))]
            cuts = left.agg(F.percentile_approx("rank", shares, 10_000)).first()[0]
            found = foreseen(left, cuts)[1:]
            cut = next((c for c, p in zip(cuts, found) if p <= most(n)), cuts[-1])
        some = left if cut is None else left.filter(F.col("rank") <= cut)
        base = stored(independent_set(some.select("id", "rank"), conflicts(some, None)).select("id", "base"), "decided")
        decided.append(base)
        if cut is None:
            break
        kept, rest = some.join(base.filter("base = id").select("id"), "id", "left_semi"), left.filter(F.col("rank") > cut)
        met = conflicts(kept, rest).join(kept.select(F.col("id").alias("a"), "rank"), "a")
        taken = stored(met.groupBy("b").agg(F.min_by("a", "rank").alias("base")).select(F.col("b").alias("id"), "base"), "decided")
        decided.append(taken)
        left, before = stored(rest.join(taken.select("id"), "id", "left_anti"), "left"), left
        free(before)
        n, pairs = foreseen(left, [None])
    return functools.reduce(DataFrame.union, decided).withColumn("kept", F.col("base") == F.col("id"))


def _kept_in_rounds(near: DataFrame) -> DataFrame:
    """id, base of the nodes of conflicts (a, ra, b, rb, both ways), round by round."""
    near = stored(near, "near")
    undecided, kept = near.select(F.col("a").alias("id"), F.col("ra").alias("rank")).distinct(), None
    while True:
        live = near.join(undecided.select(F.col("id").alias("a")), "a", "left_semi").join(undecided.select(F.col("id").alias("b")), "b", "left_semi")
        behind = live.filter("rb < ra or (rb = ra and b < a)").select(F.col("a").alias("id")).distinct()
        first = stored(undecided.join(behind, "id", "left_anti"), "first")
        kept = first if kept is None else kept.union(first)
        absorbed = live.join(first.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        before, undecided = undecided, stored(undecided.join(first, "id", "left_anti").join(absorbed, "id", "left_anti"), "undecided")
        free(before)
        if undecided.isEmpty():
            break
    base = near.join(kept.select(F.col("id").alias("b")), "b", "left_semi").groupBy("a").agg(F.min(F.struct("rb", "b")).alias("m")).select(F.col("a").alias("id"), F.col("m.b").alias("base"))
    return base.join(kept.select("id"), "id", "left_anti").unionByName(kept.select("id", F.col("id").alias("base")))
