"""Outliers, duplicates and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.moments import CUTOFFS, distance, profile, unpivot


def outlier_issues(stats: DataFrame, keys: list[str], metrics: list[str], method: str = "adaptive", threshold: float | None = None) -> DataFrame:
    """``keys, metric_name, metric_value`` of every value beyond the method's cutoff.

    One profile of all metrics (a row each) is broadcast to the values: no shuffle but of partial aggregates.
    """
    if method not in CUTOFFS:
        raise ValueError(f"unknown outlier method {method!r}; one of {sorted(CUTOFFS)}")
    cutoff = CUTOFFS[method] if threshold is None else threshold
    values = unpivot(stats, keys, metrics)
    bounds = F.broadcast(profile(stats, metrics, [method]))
    return values.join(bounds, "metric_name").filter(distance(method, F.col("metric_value")) > cutoff).select(*keys, "metric_name", "metric_value")


def outlier_sweep(stats: DataFrame, keys: list[str], metrics: list[str], methods: list[str], thresholds: list[float]) -> DataFrame:
    """``method, threshold, outlier_count`` (distinct keys) of every combination, from one profile and one scan. Only keys of
    rows beyond the least threshold are shuffled, one row each."""
    bounds = profile(stats, metrics, methods)
    fields = [c for c in bounds.columns if c != "metric_name"]
    if bounds.dropna("all", subset=fields).isEmpty():
        return stats.sparkSession.createDataFrame([], "method string, threshold double, outlier_count long")  # no values
    wide = stats.select(*keys, *(F.col(m).cast("double").alias(f"__v{i}") for i, m in enumerate(metrics)))
    one = bounds.agg(*(F.max_by(F.struct(*fields), F.col("metric_name") == m).alias(f"__p{i}") for i, m in enumerate(metrics)))
    # the furthest metric of a key decides
    each = lambda m: [F.when(F.col(f"__v{i}").isNotNull(), distance(m, F.col(f"__v{i}"), f"__p{i}")) for i in range(len(metrics))]
    far = wide.crossJoin(F.broadcast(one)).select(*keys, *(F.greatest(*each(m), F.lit(None).cast("double")).alias(f"__d{i}") for i, m in enumerate(methods)))
    beyond = F.greatest(*(F.col(f"__d{i}") for i in range(len(methods))), F.lit(None).cast("double")) > min(map(float, thresholds))
    furthest = far.filter(beyond).groupBy(*keys).agg(*(F.max(f"__d{i}").alias(f"__d{i}") for i in range(len(methods))))
    combos = [(i, m, float(t)) for i, m in enumerate(methods) for t in thresholds]
    counts = furthest.agg(*(F.count(F.when(F.col(f"__d{i}") > t, 1)).alias(f"__n{at}") for at, (i, _, t) in enumerate(combos)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(t).alias("threshold"), F.col(f"__n{at}").alias("outlier_count")) for at, (_, m, t) in enumerate(combos)))).alias("c")).select("c.*")


def level_of(issues: DataFrame, target: str = "target_index") -> tuple[DataFrame, DataFrame]:
    """Issues of whole items and of targets in them."""
    return issues.filter(F.col(target).isNull()), issues.filter(F.col(target).isNotNull())


def summary_by_metric(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct flagged keys by metric, and over all as ``Total``."""
    by = issues.select("metric_name", *keys).distinct().groupBy("metric_name").agg(F.count("*").alias("outlier_count"))
    total = issues.select(*keys).distinct().agg(F.count("*").alias("outlier_count")).select(F.lit("Total").alias("metric_name"), "outlier_count")
    return by.union(total)


def classwise_pivot(issues: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct flagged keys a class, with their share of the class's labels in percent (one decimal); ``Total`` last.
    Issues without a label count under ``unlabeled``."""
    flagged = issues.select(*keys).distinct().join(labels.select(*keys, label), keys, "left")
    name = F.coalesce(F.col(label).cast("string"), F.lit("unlabeled"))
    sizes = labels.groupBy(name.alias("class_name")).agg(F.count("*").alias("n"))
    counts = flagged.groupBy(name.alias("class_name")).agg(F.count("*").alias("outlier_count"))
    rows = counts.join(sizes, "class_name", "left")
    total = counts.agg(F.sum("outlier_count").alias("outlier_count")).crossJoin(F.broadcast(labels.agg(F.count("*").alias("n")))).select(F.lit("Total").alias("class_name"), "outlier_count", "n")
    return rows.union(total).select("class_name", F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"), F.round(100.0 * F.col("outlier_count") / F.col("n"), 1).alias("pct"))


def exact_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """``group_id, key, n_items``: the members of every group of rows with equal content (SHA-256) as rows, so that no group is
    gathered, however large; groups are named by their smallest member."""
    digest = df.filter(F.col(content).isNotNull()).select(key, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    groups = digest.groupBy("digest").agg(F.min(key).alias("group_id"), F.count("*").alias("n_items")).filter("n_items > 1")
    return digest.join(groups, "digest").select("group_id", key, "n_items")


def flagged_copies(df: DataFrame, key: str, content: str) -> DataFrame:
    """Every member of an exact group but its first: what the flag policy removes."""
    digest = df.filter(F.col(content).isNotNull()).select(key, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return digest.join(first, "digest").filter(F.col(key) > F.col("first")).select(key)


def leakage(df: DataFrame, key: str, content: str, split: str) -> DataFrame:
    """Contents that stand in two splits or more: members a split, over all pairs of splits in their order."""
    digest = df.filter(F.col(content).isNotNull()).select(F.col(split).alias("split"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    sizes = digest.groupBy("digest", "split").agg(F.count("*").alias("n"))
    a, b = (sizes.select("digest", F.col("split").alias(f"split_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = a.join(b, "digest").filter("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("groups"), F.sum("n_a").alias("members_a"), F.sum("n_b").alias("members_b"))


def leaked_members(df: DataFrame, key: str, content: str, split: str) -> DataFrame:
    """``digest, split, key`` of every row whose content stands in two splits or more."""
    digest = df.filter(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("digest"), F.col(split).alias("split"), key)
    shared = digest.groupBy("digest").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").select("digest")
    return digest.join(shared, "digest")


def clean_rows(df: DataFrame, key: str, *flagged: DataFrame) -> DataFrame:
    """The keys that no flagged set holds."""
    return df.select(key).distinct().join(flagged[0].select(key) if len(flagged) == 1 else _union(key, flagged), key, "left_anti")


def cleaning_summary(df: DataFrame, key: str, outliers: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Totals: rows, outliers, duplicates, and their union."""
    marks = outliers.select(key, F.lit(1).alias("o"), F.lit(0).alias("d")).union(duplicates.select(key, F.lit(0).alias("o"), F.lit(1).alias("d")))
    flagged = marks.groupBy(key).agg(F.max("o").alias("o"), F.max("d").alias("d"))
    rows = df.select(key).distinct().join(flagged, key, "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("original_size"), count("o").alias("outliers"), count("d").alias("duplicates"), count(F.greatest("o", "d")).alias("removed"))


def _union(key: str, frames: tuple[DataFrame, ...]) -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()


def cluster_distances(df: DataFrame, key: str, vector: str, clusters: int, seed: int = 1, algorithm: str = "kmeans") -> DataFrame:
    """``key, metric_value, cluster_id, deviations``: the distance to the cluster's centre (k-means or bisecting k-means), and
    how many population standard deviations it lies above the cluster's mean distance."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    kinds = {"kmeans": KMeans, "bisecting": BisectingKMeans}
    if algorithm not in kinds:
        raise ValueError(f"unknown cluster algorithm {algorithm!r}; one of {sorted(kinds)}")
    data = df.select(key, F.col(vector).cast("array<double>").alias("x")).filter("x is not null").withColumn("features", array_to_vector("x"))
    model = kinds[algorithm](k=clusters, seed=seed).fit(data)
    centres = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in model.clusterCenters()))
    placed = model.transform(data).withColumn("centre", centres[F.col("prediction")])
    d = F.sqrt(F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    placed = placed.select(key, F.col("prediction").alias("cluster_id"), d.alias("metric_value"))
    usual = placed.groupBy("cluster_id").agg(F.avg("metric_value").alias("mean"), F.stddev_pop("metric_value").alias("std"))
    return placed.join(F.broadcast(usual), "cluster_id").select(key, "metric_value", "cluster_id", F.when(F.col("std") > 0, (F.col("metric_value") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0)).alias("deviations"))


def cluster_outliers(df: DataFrame, key: str, vector: str, clusters: int, threshold: float, seed: int = 1, algorithm: str = "kmeans") -> DataFrame:
    """Rows more than ``threshold`` standard deviations farther from their cluster's centre than its rows on average."""
    far = cluster_distances(df, key, vector, clusters, seed, algorithm).filter(F.col("deviations") > threshold)
    return far.select(key, F.lit("cluster_distance").alias("metric_name"), "metric_value", "cluster_id")


def longest_run(df: DataFrame, order: str, flag: str, partition: list[str] | None = None) -> DataFrame:
    """Percent of flagged rows and the longest run of them in order (gaps and islands)."""
    by = partition or []
    whole = Window.partitionBy(*by).orderBy(order)
    island = Window.partitionBy(*by, flag).orderBy(order)
    runs = df.withColumn("g", F.row_number().over(whole) - F.row_number().over(island)).groupBy(*by, flag, "g").agg(F.count("*").alias("n"))
    flagged = F.col(flag)
    return runs.groupBy(*by).agg(F.round(100.0 * F.sum(F.when(flagged, F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("pct_drifted"), F.coalesce(F.max(F.when(flagged, F.col("n"))), F.lit(0)).alias("longest_run"))
