"""Connected components by alternating star contraction, on edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, goes to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` of every node with an edge; the component is its smallest node.

    Each round is stored; the driver sees two numbers of it. A hub's edges are
    reduced map-side, and adaptive execution splits its part of the join.
    """
    u, v = F.col(a), F.col(b)
    table = stored(
        edges.where(u != v).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        state = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        table = stored(_small_star(_large_star(table)), "stars")
    roots = table.select(F.col("b").alias("a"), "b").distinct()
    return table.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
