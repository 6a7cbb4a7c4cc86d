"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

A document's set holds the hashes of its word shingles. Light (small) sets meet in
common subsets of a fixed size, which they enumerate; heavy (large) sets meet in
inverted lists, which are scanned; the boundary between the two is chosen by cost
(see ``Plan``). Sets that link always meet; sets that meet are verified exactly.

Equal sets are one node, whatever their number. A list is scanned from its hub,
the member that meets most others: the hub is verified against all other members.
Members that are in different components after that can only link if they share
about half of what sets them apart from the hub; those that share so much with
other components are joined on the rarest of those differences and verified. So a list of near copies costs its length, and no
pair of different components that could link goes unverified: components are exact.

Nulls, empty texts and texts without words have empty sets: component = the own
id. Rows that repeat an id belong to one document; a row with a null id links
nothing and has a null component. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.shingles import shingle_sets
from geoloom.llm.wordhash import mix
from geoloom.operators.components import connected_components
from geoloom.session import bound_batches, free, stored

#: Words of a shingle, and least similarity in hundredths: the pipeline's, and the contract's.
WORDS, PERCENT = 5, 80
#: Parts beyond the least number, so that a set may skip its empty ones, where parts are few.
SPARE, FEW_PARTS = 2, 24
#: What a posting of a scanned list costs, in enumerated subsets: it is hashed like one, and its partners are verified.
LIST_COST = 5
#: Largest size of a group of heavy sets, in times its least.
SPREAD = 1.4


class Plan:
    """Which keys a set of each size is known by, for one threshold.

    Sets n <= m link if they share need(n, m) shingles. Up to ``light`` shingles,
    the smaller set decides: both enumerate their subsets of just need(n, m)
    shingles. Above, sizes fall into groups; in a group, linked sets differ in at
    most H shingles, so of H + 1 + spare parts of the shingles' space at least
    1 + spare hold the same for both: the part's content is the key of an
    inverted list. A set skips its poor parts (of no shingle, or of one, where
    parts are many); ``spare`` is so large that few sets have more poor parts
    than that, and those meet under keys of their own. ``light`` is where the
    sum of both costs over all sizes up to HORIZON is least.
    """

    HORIZON = 64

    def __init__(self, percent: int):
        self.percent = percent
        self._shapes: dict[tuple[int, int], tuple[int, int, int]] = {}
        costs = [sum(self._enumerated(n, b) + LIST_COST * self._listed(n, b) for n in range(1, self.HORIZON + 1)) for b in range(self.HORIZON)]
        self.light = int(np.argmin(costs))
        self._parts: dict[int, list[tuple[int, int, int, int]]] = {}
        self._sizes: dict[int, list[int]] = {}

    def need(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def partners(self, n: int) -> range:
        """Sizes that a set of n shingles may link with."""
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)

    def subset_sizes(self, n: int, light: int | None = None) -> list[int]:
        """Sizes of the subsets that a set of n shingles enumerates."""
        light = self.light if light is None else light
        return sorted({self.need(n, m) for m in self.partners(n) if min(n, m) <= light and m > 0})

    def groups(self, n: int, light: int) -> list[tuple[int, int, int, int]]:
        """(group, parts, spare, shingles of a part that is not poor) of the inverted lists of a set of n shingles."""
        out, lo, g = [], light + 1, 0
        while lo <= n:
            hi = max(lo, int(lo * SPREAD))
            top = 100 * hi // self.percent
            if n <= top:
                out.append((g, *self._shape(lo, (100 - self.percent) * (hi + top) // (100 + self.percent) + 1)))
            lo, g = hi + 1, g + 1
        return out

    def _shape(self, n: int, least: int) -> tuple[int, int, int]:
        """(parts, spare, shingles of a part that is not poor) for sets of n shingles or more and ``least`` parts without spare."""
        if least + SPARE <= FEW_PARTS:
            return least + SPARE, SPARE, 1
        if (n, least) not in self._shapes:
            for rich, most in ((2, 1.6), (1, 4.0)):
                for parts in range(least + 1, int(least * most)):
                    x = n / parts
                    poor = parts * exp(-x) * (1 + x * (rich - 1))
                    if parts - least >= poor + 3 * poor**0.5 + 1:
                        self._shapes[n, least] = parts, parts - least, rich
                        break
                if (n, least) in self._shapes:
                    break
            else:
                self._shapes[n, least] = int(least * 1.5), int(least * 1.5) - least, 1
        return self._shapes[n, least]

    def _enumerated(self, n: int, light: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n, light))

    def _listed(self, n: int, light: int) -> int:
        return sum(p for _, p, _, _ in self.groups(n, light))

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """(keys of one sorted set, how many of them it shares at least with any set that it links with)."""
        n = len(s)
        if n not in self._sizes:
            self._sizes[n], self._parts[n] = self.subset_sizes(n), self.groups(n, self.light)
        x = mix(s)
        out, need = [], 1 if self._sizes[n] else n + 1
        if self._sizes[n]:
            total = x.sum(dtype=np.uint64)
            for c in self._sizes[n]:
                sums = np.array([total - x[list(gone)].sum(dtype=np.uint64) for gone in combinations(range(n), n - c)], np.uint64) if n - c > 1 else total - x if n > c else np.array([total])
                out.append(mix(sums + np.uint64(c)))
        if self._parts[n]:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(x, out=sums[1:])
        for g, parts, spare, rich in self._parts[n]:
            width = (1 << 64) // parts + 1
            edges = np.searchsorted(s, np.arange(1, parts, dtype=np.uint64) * np.uint64(width))
            edges = np.concatenate([[0], edges, [n]])
            held = np.diff(edges)
            full = np.flatnonzero(held >= rich)
            place = np.uint64(g << 32) + full.astype(np.uint64)
            out.append(mix((sums[edges[full + 1]] - sums[edges[full]]) ^ mix(place)))
            need = min(need, max(1, spare + 1 - (parts - len(full))))
            if parts - len(full) > spare:
                if parts <= FEW_PARTS:  # which of the empty parts it shares is not known: each choice of them
                    empty = np.flatnonzero(held == 0).tolist()
                    marks = [1 << 62 | g << 48 | sum((p + 1) << 8 * k for k, p in enumerate(c)) for c in combinations(empty, spare + 1)]
                else:
                    marks = [1 << 63 | g]
                out.append(mix(np.array(marks, np.uint64)))
        return np.unique(np.concatenate(out)), need


#: Nodes whose ids may be broadcast to fetch their texts (8 bytes each); more are joined by shuffle.
BROADCAST_NODES = 1_000_000
#: Pairs of one node beyond which they are dealt to several copies of its set.
HEAVY = 1000
#: Texts that are turned into sets together.
BATCH_CHARS = 4 << 20


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and size < BATCH_CHARS:
            size += len(texts[stop] or "")
            stop += 1
        yield start, texts[start:stop]
        start = stop


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def node_of(s: np.ndarray) -> int:
    """64-bit hash of a whole set, as a signed number."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def set_keys(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, node (hash of the whole set), need, keys of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(percent)
        for b in batches:
            for start, texts in _groups(b.column("text").to_pylist()):
                n, node, need, keys = [], [], [], []
                for s in shingle_sets(texts, words):
                    n.append(len(s))
                    node.append(node_of(s) if len(s) else None)
                    found = plan.keys(s) if len(s) else (s, 0)
                    keys.append(found[0])
                    need.append(found[1])
                arrays = [b.column("doc_id").slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(need, pa.int32()), _lists(keys)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "node", "need", "keys"])

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(run, "doc_id long, n long, node long, need int, keys array<long>")


def node_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, shingles of the rows of docs (node, text) whose set is the node's: a repeated id brings rows of other sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column("node").to_pylist()
            for start, texts in _groups(b.column("text").to_pylist()):
                found = [(k, s) for k, s in zip(nodes[start:], shingle_sets(texts, words)) if len(s) and node_of(s) == k]
                arrays = [pa.array([k for k, _ in found], pa.int64()), _lists([s for _, s in found])]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "shingles"])

    bound_batches(docs.sparkSession)
    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame, many: str, other: str) -> DataFrame:
    """pairs with the sets of both nodes as ``sm`` and ``so``.

    A node of ``many`` may have any number of pairs: one with more than HEAVY has
    copies of its set, between which its pairs are dealt by their other node.
    """
    left, right = sets.select(F.col("node").alias(many), F.col("shingles").alias("sm")), sets.select(F.col("node").alias(other), F.col("shingles").alias("so"))
    heavy = pairs.groupBy(many).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY).select(many, F.ceil(F.col("n") / HEAVY).cast("int").alias("copies"))
    heavy = stored(heavy, "heavy")
    n = heavy.count()
    if not n:
        free(heavy)
        return pairs.join(left, many).join(right, other)
    if n <= BROADCAST_NODES:
        heavy = F.broadcast(heavy)
    pairs = pairs.join(heavy, many, "left").withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    left = left.join(heavy, many, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return pairs.join(left, [many, "copy"]).drop("copy").join(right, other)


def similarities(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked, na, nb (sizes), apart (size of the symmetric difference) of node pairs a, b; exact. A node may be ``a`` of any number of pairs."""
    both = _with_sets(pairs.select("a", "b"), sets, "a", "b")
    both = both.select("a", "b", F.size("sm").alias("na"), F.size("so").alias("nb"), F.size(F.array_intersect("sm", "so")).cast("long").alias("common"))
    union = F.col("na") + F.col("nb") - F.col("common")
    return both.select("a", "b", (F.col("common") * 100 >= union * percent).alias("linked"), "na", "nb", (union - F.col("common")).cast("int").alias("apart"))


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, component of every row of docs."""
    return _node_components(docs, words, percent).select("doc_id", "n", "component")


def _node_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, node, component of every row of docs."""
    base = stored(set_keys(docs, words, percent), "sets")
    nodes = base.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    members = _members(base)
    sets = _candidate_sets(docs, nodes, members, words)

    postings = members.select("key", "node")
    sized = postings.join(postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")
    score = sized.groupBy("node").agg(F.sum("size").alias("score"))
    lists = stored(sized.drop("size").join(score, "node"), "lists")  # key, node, score
    hub = lists.groupBy("key").agg(F.max(F.struct("score", "node")).alias("top")).select("key", F.col("top.node").alias("hub"))
    # the hub is the greater of the two by (score, node), so no pair comes twice the other way round
    star = stored(lists.join(hub, "key").filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
    free(members, lists)
    near = stored(similarities(star, sets, percent), "near")
    free(star)
    links = near.filter("linked").select("a", "b")
    roots = connected_components(links)
    pairs = _residual_pairs(near, roots, sets, percent)
    more = stored(similarities(pairs, sets, percent).filter("linked").select("a", "b"), "more")
    free(pairs, sets)
    if not more.isEmpty():
        before, roots = roots, connected_components(links.union(more))
        free(before)
    free(near, more)

    named = roots.join(nodes, "node").select("node", "root", "rep")
    named, before = stored(named, "named"), roots
    free(before)
    component = named.groupBy("root").agg(F.min("rep").alias("component"))
    linked = named.join(component, "root").select("node", "component")
    alone = nodes.join(linked, "node", "left").select("node", F.coalesce("component", "rep").alias("component"))
    out = base.select("doc_id", "n", "node").join(alone, "node", "left")
    return out.select("doc_id", "n", "node", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id")).alias("component"))


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node: those, once each, whose key a neighbour with another node has too.

    The first and the last key of a partition may go on in the next one, so their
    rows pass whatever they are.
    """
    names = ["key", "node", "need"]
    held: list[np.ndarray] | None = None  # rows of the latest key, which may go on
    first = True

    def alive(rows: list[np.ndarray], end: bool) -> pa.RecordBatch:
        nonlocal first
        key, node = rows[0], rows[1]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        rows = [r[new] for r in rows]
        key = rows[0]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        keep = same[1:] | same[:-1]
        if first:
            keep |= key == key[0]
        if end:
            keep |= key == key[-1]
        first = False
        return pa.RecordBatch.from_arrays([pa.array(r[keep]) for r in rows], names)

    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield alive([r[:cut] for r in rows], False)
        held = [r[cut:] for r in rows]
        if len(held[0]) > 1 << 20:  # a very long list goes out as it is
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in held], names)
            held = [r[-1:] for r in held]
            first = True
    if held is not None:
        yield alive(held, True)


def _members(base: DataFrame) -> DataFrame:
    """key, node of the lists that two nodes or more are in.

    Postings are sorted by range of key and node, so a list of any length is
    spread over tasks, and are moved once. A node that has fewer live keys than
    it needs to share with any partner has none, and goes.
    """
    postings = base.filter("doc_id is not null").select(F.explode("keys").alias("key"), "node", "need")
    live = postings.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    members = stored(live.mapInArrow(_in_runs, "key long, node long, need int").distinct(), "members")
    for _ in range(2):
        enough = members.groupBy("node", "need").agg(F.count(F.lit(1)).alias("n")).filter("n >= need").select("node")
        left = members.join(enough, "node", "left_semi")
        lists = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        members, before = stored(left.join(lists, "key", "left_semi").select("key", "node", "need"), "members"), members
        free(before)
    return members


def _residual_pairs(near: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of members of one hub's lists that may link, though their components differ.

    D(x) is the symmetric difference of x and the hub, d(x) its size. Sets x and y
    link if |x + y| (symmetric) = d(x) + d(y) - 2 |D(x) & D(y)| is at most
    H(x, y) = r (n_x + n_y); r = (100 - percent) / (100 + percent). So they share
    at least (d(x) + d(y) - H) / 2 differences. Here one of the two at least is
    not linked with the hub, and no pair with a d beyond the other's + H links:

    * x shares more than (d(x) + r (n_hub - n_x)) / 2 differences with a y that
      is not linked with the hub (``shared``), and
    * at least d(x) - H with any (``least`` = d(x) - H(x), H(x) being the largest H).

    A difference that one component has to itself is shared with none; a member
    with fewer others than it must share goes, and its differences with it
    (twice). What stays is sought by a prefix filter, the rarest first, and pairs
    whose later differences are too few for what they must share are no candidates.
    Near copies of one text differ from it by shingles of their own and do not meet.
    """
    p, q = 100 + percent, 100 - percent
    root = roots.select(F.col("node").alias("b"), "root")
    known = near.join(root, "b", "left").withColumn("root", F.coalesce("root", "b"))
    split = known.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("a")
    most = F.floor((F.col("nb") + F.floor(F.col("nb") * 100 / F.lit(float(percent)))) * q / F.lit(float(p)))
    shared = F.floor((F.col("apart") * p + (F.col("na") - F.col("nb")) * q) / F.lit(2.0 * p)) + 1
    known = known.join(split, "a").select(F.xxhash64("a", "b").alias("m"), "a", "b", "root", "linked", F.col("nb").alias("n"), F.col("apart").alias("d"), shared.alias("shared"), most.alias("most"))
    known = stored(known, "known")
    both = _with_sets(known.select("a", "b", "m", "root"), sets, "a", "b")
    differ = F.concat(F.array_except("sm", "so"), F.array_except("so", "sm"))
    # a difference is known by a hash of it and the hub; the counts and the rows they are joined with share one shuffle
    live = both.select("m", "root", F.explode(F.transform(differ, lambda e: F.xxhash64("a", e))).alias("e")).repartition("e")
    held = []
    for _ in range(2):
        held.append(stored(live.join(_shared_by_components(live), "e").select("m", "root", "e"), "live"))
        count = held[-1].groupBy("m").agg(F.count(F.lit(1)).alias("live"))
        alive = known.join(count, "m").filter("live >= if(linked, shared, greatest(1, d - most))").select("m")
        live = held[-1].join(alive, "m", "left_semi")
    live = stored(live.join(_shared_by_components(live), "e").select("m", "e", "df"), "live")
    free(*held)
    count = live.groupBy("m").agg(F.count(F.lit(1)).alias("live"))
    # places are counted among the live differences: the others, of which no two components share one, come first
    rank = F.row_number().over(Window.partitionBy("m").orderBy("df", "e"))
    ranked = live.select("m", "e", rank.alias("rank")).join(known.join(count, "m"), "m").withColumn("place", F.expr("rank + d - live"))
    one = "live >= shared and place <= if(linked, d - shared + 1, least(d - shared, most div 2) + 1)"
    two = "not linked and place <= least(d, most + 1)"
    ranked = stored(ranked.withColumn("one", F.expr(one)).withColumn("two", F.expr(two)).filter("one or two"), "ranked")
    names = ["m", "b", "root", "linked", "d", "n", "shared", "live", "rank", "place"]
    x = ranked.filter("one").select("e", *[F.col(c).alias(f"x_{c}") for c in names])
    y = ranked.filter("two").select("e", *[F.col(c).alias(f"y_{c}") for c in names])
    roles = "x_root <> y_root and (x_linked or ((x_d, x_m) < (y_d, y_m) and y_place <= y_d - y_shared + 1))"
    enough = f"least(x_live - x_rank, y_live - y_rank) + 1 >= ceil((x_d + y_d - floor({q} * (x_n + y_n) / {p}.0)) / 2.0)"
    met = x.join(y, "e").filter(f"{roles} and {enough}")
    out = stored(met.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct(), "residual")
    free(live, known, ranked)
    return out


def _shared_by_components(live: DataFrame) -> DataFrame:
    """e, df of the differences that members of two components or more have."""
    return live.groupBy("e").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("e", "df")


def _candidate_sets(docs: DataFrame, nodes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """node, shingles of all nodes that are in a list, each from one of its rows."""
    wanted = stored(members.select("node").distinct().join(nodes, "node"), "wanted")
    side = wanted.select(F.col("rep").alias("doc_id"), "node")
    side = F.broadcast(side) if wanted.count() <= BROADCAST_NODES else side.hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(side, "doc_id")
    made = node_sets(texts, words)
    once = stored(made, "shingles")
    free(wanted)
    twice = once.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return once if twice.isEmpty() else stored(once.dropDuplicates(["node"]), "shingles")  # equal rows of one id


def keep_one_of_each_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns.

    Rows are judged by id and node: of an id with several texts, only those go that link to a smaller id.
    """
    found = _node_components(docs, words, percent)
    moved = F.col("component") != F.col("doc_id")
    ids = found.groupBy("doc_id").agg(F.count(F.when(moved, 1)).alias("lost"), F.count(F.lit(1)).alias("n")).filter("lost > 0")
    ids = stored(ids.select("doc_id", (F.col("lost") < F.col("n")).alias("mixed")), "gone")
    kept = docs.join(ids.filter("not mixed").select("doc_id"), "doc_id", "left_anti")
    mixed = ids.filter("mixed").select("doc_id")
    if mixed.isEmpty():
        return kept
    h = F.xxhash64("text")
    texts = stored(docs.select(F.col("doc_id").cast("long"), "text").join(mixed, "doc_id", "left_semi").withColumn("h", h), "mixed")
    nodes = set_keys(texts.select(F.col("h").alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("h"), "node").distinct()
    gone = found.filter(moved).select("doc_id", "node").join(mixed, "doc_id", "left_semi").distinct()
    gone = texts.select("doc_id", "h").distinct().join(nodes, "h").join(gone, ["doc_id", "node"]).select("doc_id", F.col("h").alias("__h")).distinct()
    return kept.withColumn("__h", h).join(stored(gone, "gone"), ["doc_id", "__h"], "left_anti").drop("__h")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9, as the contract has it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_components(docs, 3, 90).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
SQL = {
    "op5_ngram_jaccard_join": r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) end as s
  from words
), grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
common as (
  select x.doc_id as a, y.doc_id as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as c
  from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id
), links as (select a, b from common where 100 * c >= 90 * (n + m - c)),
reach as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.b)::bigint as component_id from sets s join reach r on s.doc_id = r.a group by s.doc_id, s.s
"""
}
