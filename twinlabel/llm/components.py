"""Connected components of a graph given as pairs, by alternating star contraction.

Every round links each node's larger neighbours to the smallest node it knows, then each
node's smaller neighbours likewise, until nothing changes; the graph ends as one star per
component.  Both halves are a minimum per node, combined before the shuffle, and a join
whose other side has one row per node, so the hub of a large component is an ordinary key
that the engine may split.  Each round's pairs are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, scratch_dir, written


def _stars(pairs: DataFrame, upward: bool) -> DataFrame:
    """Pairs (a, b) turned into stars around the smallest neighbour of each node.

    ``upward`` looks at all neighbours and moves the larger ones, else the smaller ones
    and the node itself are moved.
    """
    if upward:
        near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    joined = near.join(least, "a")
    if upward:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the pairs (a, b).

    Nodes are orderable and not null; a pair of a node with itself says nothing.
    """
    spark = pairs.sparkSession
    path = scratch_dir(spark, "stars")
    edges = written(pairs.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "stars", path)
    before = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if state == before:
            break
        before = state
        old, path = path, scratch_dir(spark, "stars")
        edges = written(_stars(_stars(edges, True), False), "stars", path)
        clear(spark, old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
