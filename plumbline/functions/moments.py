"""Per-metric profiles and outlier bounds, from aggregate passes over all metrics at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.quantiles import exact_quantiles

#: Default cutoffs: literature conventions, but for ``adaptive``, whose default is documented.
CUTOFFS = {"zscore": 3.0, "modzscore": 3.5, "iqr": 1.5, "adaptive": 3.5}
#: ``adaptive`` takes the modified z-score of a metric with more skewness or excess kurtosis than this (our choice).
SKEW_LIMIT, KURTOSIS_LIMIT = 1.0, 3.0
#: Consistency constants of the modified z-score (median and mean absolute deviation).
MAD_SCALE, MEAN_AD_SCALE = 0.6745, 1.2533


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys, metric_name, metric_value``: one row a metric; nulls stay out."""
    wide = df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics))
    return wide.unpivot(keys, metrics, "metric_name", "metric_value").filter("metric_value is not null")


#: What each method compares values with.
NEEDS = {"zscore": {"moments"}, "modzscore": {"quartiles", "deviation"}, "iqr": {"quartiles"}, "adaptive": {"moments", "quartiles", "deviation"}}


def profile(df: DataFrame, metrics: list[str], methods: Iterable[str] = tuple(NEEDS)) -> DataFrame:
    """One row a metric with what the methods need: mean, population std, skewness, excess kurtosis (one pass); quartiles;
    median and mean absolute deviation. The rest is null. Values are never sorted in one task."""
    needs = set().union(*(NEEDS[m] for m in methods))
    values = unpivot(df, [], metrics)
    spark = df.sparkSession
    held = lambda part: spark.createDataFrame(part.collect(), part.schema)  # noqa: E731  a row a metric, computed once
    v = F.col("metric_value")
    parts: list[DataFrame] = []
    if "moments" in needs:
        parts.append(values.groupBy("metric_name").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt")))
    if "quartiles" in needs:
        quartiles = held(exact_quantiles(values, "metric_name", "metric_value", [0.25, 0.5, 0.75]).select("metric_name", "q"))
        parts.append(quartiles)
        if "deviation" in needs:
            off = values.join(F.broadcast(quartiles), "metric_name").select("metric_name", F.abs(v - F.col("q")[1]).alias("off"))
            parts.append(exact_quantiles(off, "metric_name", "off", [0.5]).select("metric_name", F.col("q")[0].alias("mad")))
            parts.append(off.groupBy("metric_name").agg(F.avg("off").alias("mead")))
    out = spark.createDataFrame([(m,) for m in metrics], "metric_name string")
    for part in parts:
        out = out.join(F.broadcast(part), "metric_name", "left")
    out = held(out)
    kinds = {"mean": "double", "std": "double", "q": "array<double>", "skew": "double", "kurt": "double", "mad": "double", "mead": "double"}
    return out.select("metric_name", *(F.col(n) if n in out.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()))


def distance(method: str, value: Column, profile: str = "") -> Column:
    """How far a value lies from its metric's profile (columns, or fields of the column ``profile``), in the method's own
    units (compare with its cutoff)."""
    of = lambda name: F.col(f"{profile}.{name}" if profile else name)
    z = F.when(of("std") > 0, F.abs(value - of("mean")) / of("std")).otherwise(F.lit(0.0))
    off = F.abs(value - of("q")[1])
    modified = F.when(of("mad") > 0, F.lit(MAD_SCALE) * off / of("mad")).when(of("mead") > 0, off / (F.lit(MEAN_AD_SCALE) * of("mead"))).otherwise(F.lit(0.0))
    if method == "zscore":
        return z
    if method == "modzscore":
        return modified
    if method == "iqr":
        spread = of("q")[2] - of("q")[0]
        beyond = F.greatest(of("q")[0] - value, value - of("q")[2], F.lit(0.0))
        return F.when(beyond == 0, F.lit(0.0)).when(spread > 0, beyond / spread).otherwise(F.lit(float("inf")))
    if method == "adaptive":
        heavy = (F.abs(of("skew")) > SKEW_LIMIT) | (of("kurt") > KURTOSIS_LIMIT)
        return F.when(heavy, modified).otherwise(z)
    raise ValueError(f"unknown outlier method {method!r}; one of {sorted(CUTOFFS)}")
