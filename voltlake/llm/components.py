"""Connected components of an edge table by alternating large-star and small-star steps.

Edges are two bigint columns, `a` and `b`, without nulls. Every step is an aggregation and a join, nothing is
collected; each round's edges are written to the shared folder, so that lost executors cost one round at most. Joins
meet their counts under a key of their own, so that Spark can split the partition of a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _least(edges: DataFrame) -> DataFrame:
    """Of each node its least neighbour or itself, keyed by the node's complement: that way the join deals it out anew."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not(F.col("a")).alias("k"), F.least("m", "a").alias("m"))


def _with_least(edges: DataFrame) -> DataFrame:
    return edges.join(_least(edges), F.bitwise_not(edges["a"]) == F.col("k")).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _with_least(down)
    pair = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return near.select(pair.alias("e")).select("e.a", "e.b").where("a > b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge, and none leads to a node that has one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    of = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root` (the least node of its component) of every node that has an edge and isn't its own root."""
    stars = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(stars):
        stars = stash(_small_star(_large_star(stars)))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
