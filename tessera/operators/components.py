"""Connected components of an edge table, without driver-side state.

Large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond"): every node's
neighbours are tied to the smallest of them, from above and from below in turn, until the edges are stars.
A node with very many neighbours costs a pre-aggregated minimum and a join that the optimizer can split.
Each round is written to the shared folder, so the plan does not grow and a lost executor costs one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node): a row for each node with an edge to another. Nulls and loops are ignored."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u > v").distinct()
    pairs = materialize(pairs, "edges")
    for _ in range(max_rounds):
        before, pairs = pairs, materialize(_small_star(_large_star(pairs)), "stars")
        release(before)
        # Done when no node that others are tied to is tied to another itself.
        if not pairs.select("v").distinct().join(pairs.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's smallest neighbour, itself included."""
    both = pairs.union(pairs.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    joined = both.filter("v > u").join(least, F.col("u") == F.col("n"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is tied to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    joined = pairs.join(least, F.col("u") == F.col("n"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(least.select("n", "m")).distinct()


def joined_components(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`labels` (node, component) with more edges: only components are tied, so the work follows the new edges."""
    left = labels.select(F.col("node").alias(a), F.col("component").alias("u"))
    right = labels.select(F.col("node").alias(b), F.col("component").alias("v"))
    tied = edges.select(a, b).join(left, a, "left").join(right, b, "left").select(F.coalesce("u", a).alias("a"), F.coalesce("v", b).alias("b"))
    merged = materialize(connected_components(tied), "merged")
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    out = materialize(old.union(merged.select("node", "component")).distinct(), "labels")
    release(merged)
    return out
