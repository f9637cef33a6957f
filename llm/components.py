"""Connected components of an undirected graph by alternating large and small stars.

Each star step points the neighbours of a node at the least node around it; the number of
rounds grows with the logarithm of the longest path. Minima are combined before the
shuffle, so a node with very many neighbours is no hot group, and the join that follows has
plain shuffles on both sides, which Spark splits where they are skewed. Every step is a
stored table: lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with u > v. Large: neighbours above a node move to its minimum; small: those below."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stored(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "star-least")
    if large:   # (u, v) with v > u: v goes to the minimum around u
        upward = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        moved = upward.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            least.select("u", F.col("low").alias("v")))
    return stored(moved.where("u > v").distinct(), "star")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node.

    Links of a node to itself and repeated links do nothing; nodes must not be null.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "star")
    mark = _mark(edges)
    while mark[0]:
        edges = _star(_star(edges, large=True), large=False)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
