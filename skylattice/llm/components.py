"""Connected components of a graph given as edges, by alternating large and small stars.

Each pass is a minimum per node (combined on the map side) and an equi-join; its edges are written to the shared folder,
so the lineage stays short and lost executors cost one pass at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def _hung(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the larger (or the smaller, with itself) neighbours of each node below the smallest of its neighbourhood."""
    if large:
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # edges point from larger to smaller nodes
        sides = edges
    least = settled(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = sides.join(least, "a")
    moved = joined.filter("b > a").select("b", "m") if large else joined.select("b", "m").union(least.select("a", "m"))
    return moved.toDF("a", "b").filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (first two columns, any order); the component is its smallest node.

    Edges with a null end and loops count for nothing; repeated edges count once.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNull() | F.col(b).isNull())
    pairs = settled(pairs.filter(~F.col(pairs.columns[2]) & (F.col("a") != F.col("b"))).select("a", "b").distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(pairs)
    while before[0]:
        pairs = settled(_hung(settled(_hung(pairs, True), "large"), False), "small")
        after = state(pairs)
        if after == before:
            break
        before = after
    # every node now hangs directly below its component's smallest
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select("b", "b").distinct())
