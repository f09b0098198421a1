"""Connected components by alternating large-star and small-star.

Edges stay a table of two longs; every node ends up linked to the smallest id it can reach. Each half-step is one
aggregation (combined before the shuffle, its result written so that the join reads both sides from a shuffle) and one
join on the node, whose large groups adaptive execution splits; the edge table is written after each half-step, so a lost executor costs little. Edges that already form stars need no round; rounds grow with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller root that has none itself. Every edge has its larger end first."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    wrong = (F.sum("down") > 1) | ((F.max("down") == 1) & (F.max("up") == 1))
    return ends.groupBy("x").agg(wrong.alias("wrong")).where("wrong").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    near = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return near.union(low.select("u", "m")).where("a <> b").distinct()


def stars(links: DataFrame) -> DataFrame:
    """Few edges with the components of many: ``links`` tie each _id to several lows; each _id and its other lows are tied to the least of them."""
    own = links.groupBy("_id").agg(F.min("low").alias("b"), F.collect_set("low").alias("lows"))
    return own.select(F.explode(F.array_append("lows", F.col("_id"))).alias("a"), "b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that isn't itself the smallest of its component. ``edges``: two long columns."""
    down = edges.toDF("x", "y").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    now = written(down.distinct(), "edges")  # the half-steps keep the larger end first
    while not _is_star(now):
        now = written(_small_star(written(_large_star(now), "large-star")), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
