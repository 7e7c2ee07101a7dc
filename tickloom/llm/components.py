"""Connected components by alternating large and small stars; every round is written to the shared folder.

A node with a third of all links is no hot key: the smallest neighbour is an aggregate that combines before the shuffle,
and joins on the node are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop, save


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every neighbour above a node on the smallest of the node and its neighbours."""
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its neighbours below it on the smallest of those."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return hung.where("a < b").union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable."""
    now = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = None
    for _ in range(max_rounds):
        after = save(_small_star(_large_star(now)))
        drop(now)
        now, before = after, mark
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
