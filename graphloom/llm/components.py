"""Connected components by alternating star contraction: distributed, no links on the driver.

Each round gives every node's larger neighbours to its smallest neighbour (large star), then every node's smaller
neighbours to their smallest (small star). The graph ends as stars round the smallest node of each component. A hub with
many links is only ever summed by a minimum, which is combined before the shuffle, or joined, which adaptive execution
splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import drop_staged, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b. Each a's neighbours below it, and a itself, go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node) of each node that has a link to another. edges: a, b in any order, repeats allowed.

    Null ends are left out; an empty table gives no rows."""
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    current, mark = staged(current, "edges"), None
    for _ in range(rounds):
        following = staged(_small_star(_large_star(current).filter("a > b").distinct()).filter("a > b").distinct(), "edges")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_staged(current)
        current = following
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
