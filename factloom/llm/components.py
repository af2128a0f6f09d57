"""Connected components by alternating star contractions, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (itself included).

    The smallest neighbours are a table of their own, here and below: a join
    whose sides are plain exchanges can split a hub's links.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    least = scratch.table(down.groupBy("a").agg(F.min("b").alias("m")))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the component's smallest node.

    edges: a, b, comparable and without NULL. Each round is a written table, so a
    lost executor costs one round at most; rounds grow as the logarithm of a
    component's size. A hub's links are joined to one small row, so that adaptive
    execution can split them.
    """
    now = scratch.table(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        after = scratch.table(_small_star(_large_star(now, scratch), scratch))
        n, state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(now)
        now = after
        if (n, state) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (n, state)
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
