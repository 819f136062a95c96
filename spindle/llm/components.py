"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import cut, drop


def stars(edges: DataFrame) -> bool:
    """Whether every node of the edges ``a > b`` is either a centre or tied to one centre only."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a``, ``b``); ``root`` is the smallest node that is reachable.

    Each step keeps the edge count within that of the input and writes its result, so nothing is gathered in one place;
    the number of steps grows with the logarithm of the largest component.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")  # written, so that the join below can split a hub
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), "large")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        moved = small.select(F.col("a").alias("x"), F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        old, now = now, cut(moved.where("a <> b").select("a", "b").distinct(), "edges")
        drop(old, least, large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
