"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins the smaller neighbours of a node, and the node, to the smallest of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def connect(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for each node of the edges (``a`` < ``b``, long).

    Minima are pre-aggregated and a node's neighbours are never collected, so a hub is only a skewed join key, which
    adaptive execution splits. Each round is written to ``scratch``, where the result lies too, in the place of the one
    before; the number of rounds grows with the logarithm of the graph's size. An edge table without rows has no
    components.
    """
    now = scratch.table(edges.filter("a < b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if state.n == 0 or (before is not None and (state.n, state.h) == before):
            break
        before = (state.n, state.h)
        now = scratch.table(_small_star(_large_star(now)), "edges")
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
