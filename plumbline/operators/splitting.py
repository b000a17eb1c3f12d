"""Test holdout, folds, rebalancing, and how far they deviate from the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.ordering import ranked, shuffled


def stratified(df: DataFrame, key: str, label: str, test_frac: float = 0.2, val_frac: float = 0.1, folds: int = 1, seed: int = 0) -> DataFrame:
    """``key, label, split, fold``: of each class, round(test_frac * n) rows are ``test`` (fold null). One fold: of the
    rest round(val_frac * n) are ``val``. Several: each row of the rest has the fold in which it is validation."""
    rows = ranked(df.select(key, label).withColumn("__h", shuffled(key, seed)), [label], "__h", key)
    sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
    rows = rows.alias("r").join(sizes.alias("s"), F.col(f"r.{label}").eqNullSafe(F.col(f"s.{label}"))).select(F.col(f"r.{key}"), F.col(f"r.{label}"), "rank", "__n")
    held = F.floor(F.lit(float(test_frac)) * F.col("__n") + 0.5).cast("long")
    if folds <= 1:
        val = F.floor(F.lit(float(val_frac)) * F.col("__n") + 0.5).cast("long")
        split = F.when(F.col("rank") <= held, "test").when(F.col("rank") <= held + val, "val").otherwise("train")
        fold = F.when(F.col("rank") > held, F.lit(0))
    else:
        split = F.when(F.col("rank") <= held, "test").otherwise("train")
        fold = F.when(F.col("rank") > held, (F.col("rank") - held - 1) % folds)
    return rows.select(key, label, split.alias("split"), fold.cast("long").alias("fold"))


def grouped(df: DataFrame, key: str, group: str, test_frac: float = 0.2, folds: int = 5, seed: int = 0) -> DataFrame:
    """``key, split, fold`` with whole groups on one side: a hash of the group decides."""
    share = F.conv(F.substring(shuffled(group, seed), 1, 8), 16, 10).cast("long")
    test = share < int(test_frac * 2**32)
    fold = F.conv(F.substring(shuffled(group, seed), 9, 8), 16, 10).cast("long") % folds
    return df.select(key, group, F.when(test, "test").otherwise("train").alias("split"), F.when(~test, fold).alias("fold"))


def rebalanced(df: DataFrame, key: str, label: str, method: str = "global", seed: int = 0) -> DataFrame:
    """A subset with evener classes: global takes as many of each class as the smallest has; interclass takes at most
    the median class size."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    if method == "global":
        goal = counts.agg(F.min("n").alias("goal"))
    elif method == "interclass":
        goal = counts.agg(F.floor(F.percentile("n", F.lit(0.5))).alias("goal"))
    else:
        raise ValueError(f"unknown balance method {method!r}")
    rows = ranked(df.withColumn("__h", shuffled(key, seed)), [label], "__h", key)
    return rows.crossJoin(F.broadcast(goal)).filter(F.col("rank") <= F.col("goal")).drop("rank", "goal", "__h")


def deviation(assigned: DataFrame, label: str, split: str = "split") -> DataFrame:
    """``split, class_name, deviation``: for every split its class that is furthest from the whole's share, in
    percentage points (one decimal), ties to the class that sorts first."""
    name = F.col(label).cast("string")
    whole = assigned.groupBy(name.alias("class_name")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    part = assigned.groupBy(F.col(split).alias("split"), name.alias("class_name")).agg(F.count("*").alias("k"))
    sizes = part.groupBy("split").agg(F.sum("k").alias("size"))
    grid = sizes.crossJoin(F.broadcast(whole.select("class_name", "p"))).join(part, ["split", "class_name"], "left")
    gap = F.round(100 * F.abs(F.coalesce("k", F.lit(0)) / F.col("size") - F.col("p")), 1)
    first = Window.partitionBy("split").orderBy(F.col("deviation").desc(), "class_name")
    return grid.select("split", "class_name", gap.alias("deviation")).withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
