"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.session import stage


def _rank(node: str) -> Column:
    """A hash order of the nodes: it has no long falling chains, whatever the order of the ids."""
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("v"))


def _follow(parents: DataFrame) -> DataFrame:
    """Each node's grandparent in place of its parent."""
    upper = parents.select(F.col("_x").alias("_up"), F.col("_up").alias("_upper"))
    return parents.join(upper, "_up", "left").select("_x", F.coalesce("_upper", "_up").alias("_up"))


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(node, component): the smallest node of each component.

    Each round points every node at the neighbour that comes first in a hash order, follows the
    pointers up to four steps, and goes on with the edges between different ends; their number falls
    by a factor each round. A hub is pre-aggregated where its neighbours are gathered, and its edges
    are one side of a plain join, which adaptive execution splits. Two staged tables a round.
    """
    left = stage(edges.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).where("_a != _b").distinct())
    rounds = []
    while not left.isEmpty():
        both = left.select(F.col("_a").alias("_x"), F.col("_b").alias("_y")).unionByName(left.select(F.col("_b").alias("_x"), F.col("_a").alias("_y")))
        first = both.groupBy("_x").agg(F.min(_rank("_y")).alias("_m"))
        parents = first.select("_x", F.least(F.col("_m"), _rank("_x"))["v"].alias("_up"))
        parents = stage(_follow(_follow(parents)))
        rounds.append(parents)
        ends = parents.select(F.col("_x").alias("_a"), F.col("_up").alias("_ua"))
        others = parents.select(F.col("_x").alias("_b"), F.col("_up").alias("_ub"))
        moved = left.join(ends, "_a").join(others, "_b")
        left = stage(moved.select(F.least("_ua", "_ub").alias("_a"), F.greatest("_ua", "_ub").alias("_b")).where("_a != _b").distinct())
    every = nodes.select(F.col(node).alias("_v")).distinct()
    if not rounds:
        return every.select(F.col("_v").alias(node), F.col("_v").alias("component"))
    roots = rounds[0].select(F.col("_x").alias("_v"), F.col("_up").alias("_r"))
    for later in rounds[1:]:
        roots = roots.join(later.withColumnRenamed("_x", "_r"), "_r", "left").select("_v", F.coalesce("_up", "_r").alias("_r"))
    roots = stage(roots)
    smallest = roots.groupBy("_r").agg(F.min("_v").alias("component"))
    found = roots.join(smallest, "_r").select("_v", "component")
    return every.join(found, "_v", "left").select(F.col("_v").alias(node), F.coalesce("component", "_v").alias("component"))
