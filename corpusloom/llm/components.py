"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation (combined before the shuffle) and a join that adaptive
execution may split, so a hub with many edges does not meet in one task.  Edges live in
the checkpoint folder between rounds; only one checksum per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is tied to the smallest node around u."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of u, and u, is tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    edges: columns a and b (long, not null).  Loops and repeats are harmless; no edges give no rows.
    """
    edges = checkpoint(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    for _ in range(max_rounds):
        edges = checkpoint(_small_star(_large_star(edges)).distinct())
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.sum(F.xxhash64("b", "a") % F.lit(1 << 40))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
