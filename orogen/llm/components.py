"""Connected components by alternating large-star and small-star steps; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to the least of them and itself: the larger neighbours, or (small) the smaller ones."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that both sides of the join are plain shuffles and Spark can split a node that very many edges have
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    moved = both.filter("b > a") if large else both
    found = moved.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        found = found.unionByName(least.select("a", F.col("m").alias("b")))
    after = written(found.filter("a <> b").distinct(), "links")
    forget(least)
    return after


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it is linked with) for every node of edges(a, b); nodes are long. Loops and repeats are allowed.

    Ends when a round changes nothing, after a number of rounds that grows with the logarithm of the nodes.
    """
    seen = None
    now = written(edges.filter("a <> b").distinct(), "links")
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == seen:
            break
        seen = told
        middle = _star(now, True)
        forget(now)
        now = _star(middle, False)
        forget(middle)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
