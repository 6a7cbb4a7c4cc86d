"""Connected components of an edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import free, stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (its component's smallest node) of all nodes of edges (a, b: longs).

    Every round links each node's neighbours to the smallest of them, first the
    larger ones, then the smaller ones; a chain of n nodes takes about log n
    rounds, and the last one repeats the state; if none of ``most_rounds`` does, that
    is an error. Each round is written to the shared folder, so that neither lineage
    nor a lost executor makes earlier rounds run again. A hub's neighbours are
    only ever aggregated by minimum and joined with it, never gathered.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "star")
    state = None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("m < u")).distinct().filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        pairs, before = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "star"), pairs
        free(before)
        seen = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components have not converged in {most_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
