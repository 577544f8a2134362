"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` from ``a, b``; the component is its smallest node. Nodes of any orderable type.

    Each round takes the smallest label among a node and its neighbours, then the label of that label.
    Rounds grow with the logarithm of the longest path; every round is checkpointed.
    """
    return _settled(_both_ways(edges))


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge ``a, b`` once in either direction, worked out once."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return cut(edges.select(F.explode(ways).alias("way")).select("way.a", "way.b").distinct())


def _settled(both: DataFrame) -> DataFrame:
    """``node, component`` of edges that stand in both directions."""
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"], "left").select("node", "component", F.least("component", "near").alias("least"))
        parents = labels.select(F.col("node").alias("parent"), F.col("component").alias("above"))
        jumped = cut(moved.join(parents, F.col("least") == F.col("parent"), "left").select("node", "component", F.least("least", "above").alias("next")))
        labels = jumped.select("node", F.col("next").alias("component"))
        if not jumped.where(F.col("next") != F.col("component")).limit(1).count():
            return labels


def merged_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, component``) after more links ``a, b``; only links between components are worked on."""
    above = labels.select(F.col("node").alias("_node"), "component")
    one = links.join(above, F.col("a") == F.col("_node"), "left").select("b", F.coalesce("component", "a").alias("a"))
    two = one.join(above, F.col("b") == F.col("_node"), "left").select("a", F.coalesce("component", "b").alias("b"))
    between = _both_ways(two.where("a != b"))
    if not between.take(1):
        return labels
    joined = _settled(between).withColumnsRenamed({"node": "_old", "component": "_new"})
    moved = labels.join(joined, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("_new", "component").alias("component"))
    fresh = joined.join(labels, F.col("_old") == F.col("node"), "left_anti").select(F.col("_old").alias("node"), F.col("_new").alias("component"))
    return cut(moved.unionByName(fresh))
