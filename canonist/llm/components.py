"""Connected components by alternating large-star and small-star steps, each a shuffle and a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v), u > v. large: every larger neighbour of a node goes to its least neighbour; else every smaller one does."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least.hint("merge"), "u")
    if large:
        return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of an edge u, v (longs). Edges may repeat, turn round or loop."""
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        # done when every node has one smaller neighbour and no such neighbour has one itself
        now = pairs.agg(F.count("u").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or now == before:
            break
        before = now
        pairs = scratch.stored(_star(_star(pairs, True), False), "edges")
        scratch.drop("edges", but=1)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
