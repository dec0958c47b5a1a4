"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step over distinct pairs (a > b): neighbours move to the least neighbour of each node.

    larger: of every node its larger neighbours move; else of every node its
    smaller ones and the node itself. The least neighbours come from partial
    sums; the join on a node of very many links is one that Spark splits.
    """
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = edges.join(least, "a")
    if larger:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of the links the smallest node that it reaches.

    Alternates large-star and small-star steps until every node hangs on one
    that hangs on none. Null ends and links of a node to itself are left out;
    links may repeat and point either way.
    """
    a, b = F.col(a), F.col(b)
    pairs = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    pairs = stash(pairs, "links")
    while True:
        hung = pairs.groupBy("a").agg(F.count("*").alias("n"))
        twice = hung.where("n > 1").select("a").unionByName(pairs.select(F.col("b").alias("a")).distinct().join(hung, "a", "left_semi"))
        if twice.isEmpty():
            break
        pairs = stash(_star(_star(pairs, larger=True), larger=False), "stars")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
