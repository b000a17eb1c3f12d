"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, settled


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of its component) for every node of ``edges`` (a, b: long).

    Each round every node points to its smallest neighbour, edges move to what their ends point to, and inner edges
    vanish; star-shaped edges take two rounds. Partial minima keep hot nodes apart, and joins are inner joins that the
    engine may split where a node holds many edges. Each round is a written table, so lost executors repeat one round.
    """
    left = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select(F.col("b").alias("node"), F.col("b").alias("to")))
        points = settled(both.groupBy("node").agg(F.min("to").alias("to")))
        rounds.append(points)
        ends = left.join(points.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("b", "x")
        ends = ends.join(points.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        before, left = left, settled(ends.filter("a <> b").distinct())
        discard(before)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0].select("node", F.col("to").alias("root"))
    for points in rounds[1:]:
        found = found.join(points.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return found
