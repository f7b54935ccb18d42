"""Connected components of links, in rounds of joins and aggregates.

Each round alternates two steps (large star, small star) that link every node to the
smallest neighbour it knows; the links become stars around the smallest node of each
component. Every round is written to the shared folder. Nothing is gathered: a node's
neighbours meet only in aggregates with partial sums and in joins whose hot keys Spark's
adaptive skew handling splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    larger = both.where(F.col("b") > F.col("a"))
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; a > b throughout."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m"))
    moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node in a link of columns ``a, b``.

    The component is its smallest node. Links may repeat and have either direction; a
    link of a node to itself, or with a null, says nothing.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = written(ordered.distinct(), "links")
    nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct().count()
    # A component of n nodes has n - 1 links at least, and one centre at least. So there
    # are as many links as nodes without the centres only if all components are stars.
    while now.count() != nodes - now.select("b").distinct().count():
        now = written(_small_star(_large_star(now)), "stars")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(centres)
