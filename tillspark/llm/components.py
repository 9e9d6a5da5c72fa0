"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _pointed(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) for every node of ``edges`` (a, b).

    Each step replaces the edges of a node by edges to its smallest neighbour, which keeps components and
    shortens paths; it ends when every edge leads to its component's smallest node.  Steps are written to
    the shared folder.
    """
    edges = staged(_pointed(edges).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(_pointed(large).distinct(), "edges")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a")
        edges = staged(_pointed(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))).distinct(), "edges")
        # done when no node has two edges, nor an edge that leads to a node with an edge
        twice = edges.groupBy("a").count().where("count > 1").select("a")
        onward = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
        if twice.unionByName(onward).isEmpty():
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
