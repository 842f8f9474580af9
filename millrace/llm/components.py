"""Connected components of an edge table, by alternating large and small stars.

Every round replaces edges by edges to smaller neighbours and never makes more of them; it ends
when only stars are left, after one or two rounds for shallow graphs. Each round's edges are a written
table, so lineage stays short and a lost executor costs one round's part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _least_neighbour(edges: DataFrame, own: bool) -> DataFrame:
    """(u, m): the least of u's neighbours and, if `own`, u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return least.withColumn("m", F.least("u", "m")) if own else least


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least_neighbour(both, own=True), "u")
    return joined.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges point to the smaller end already.
    joined = edges.join(_least_neighbour(edges, own=False), "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, which points to none: then each points to its component's least."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("met"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("met")))
    nodes = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("met").alias("met"))
    return nodes.where("points > 1 OR (points > 0 AND met > 0)").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of an edge with the smallest node that it reaches."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    current = None
    while current is None or not _settled(current):
        large = written(_large_star(pairs if current is None else current), "star")
        small = written(_small_star(large), "star")
        discard(large, *([] if current is None else [current]))
        current = small
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
