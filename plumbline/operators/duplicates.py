"""Near duplicates by shared signatures or short edges, merged over methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.quantiles import quantile
from plumbline.operators.neighbors import knn


def signature_edges(df: DataFrame, key: str, signatures: dict[str, str]) -> DataFrame:
    """``a, b, method``: members of each group with an equal signature, as a star around the smallest: a group of n has
    n - 1 edges. ``signatures``: method -> column; null or empty ones group nothing."""
    entries = F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).cast("string").alias("sig")) for m, c in signatures.items()))
    rows = df.select(F.col(key).alias("a"), F.explode(entries).alias("e")).select("a", "e.method", "e.sig").filter("sig is not null and sig <> ''")
    centres = rows.groupBy("method", "sig").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(centres, ["method", "sig"]).filter("a <> b").select("a", "b", "method")


def short_edges(df: DataFrame, key: str, vector: str, sensitivity: float = 0.5, k: int = 5) -> DataFrame:
    """Edges of the k-nearest-neighbour graph shorter than ``sensitivity`` times the median nearest-neighbour distance."""
    near = knn(df, df, key, vector, k).checkpoint()
    scale = quantile(near.filter(F.col("rank") == 1), "dist", [0.5]).select(F.col("q")[0].alias("scale"))
    return near.crossJoin(F.broadcast(scale)).filter(F.col("dist") < sensitivity * F.col("scale")).select(F.col(key).alias("a"), F.col("neighbor").alias("b"), F.lit("cluster").alias("method"))


def merged_groups(edges: DataFrame) -> DataFrame:
    """``key, group_id``: connected components over all methods; a group's id is its smallest member.

    Labels move to the smallest neighbour's, then to their label's label, until none changes; each round is
    checkpointed to the cluster's shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("group_id")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "group_id"), "b").groupBy(F.col("a").alias("key")).agg(F.min("group_id").alias("m"))
        moved = labels.join(near, "key").select("key", F.least("group_id", "m").alias("g"), F.col("group_id").alias("was"))
        jumped = moved.join(moved.select(F.col("key").alias("g"), F.col("g").alias("further")), "g").select("key", F.least("g", "further").alias("group_id"), "was").checkpoint()
        labels = jumped.select("key", "group_id")
        if jumped.filter("group_id <> was").isEmpty():
            return labels


def near_groups(edges: DataFrame) -> DataFrame:
    """``group_id, n_items, methods``: merged groups with the methods that found them."""
    labels = merged_groups(edges)
    methods = edges.join(labels, F.col("a") == F.col("key")).groupBy("group_id").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    return labels.groupBy("group_id").agg(F.count("*").alias("n_items")).join(methods, "group_id")
