"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanguard.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b) that isn't its component's smallest.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest node next to it, until all edges lead to roots. A node's neighbours
    are never gathered: their minimum is an aggregate that is joined back.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    while True:
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        ends = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 or up = 1 and down = 1").isEmpty():  # each node has one edge, to a root
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
        # Large star: the larger neighbours of a node go to the smallest of all.
        large = stored(
            both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        # Small star: a node and its smaller neighbours go to the smallest of these.
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(low, "a")
        edges = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct(),
            "edges",
        )
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
