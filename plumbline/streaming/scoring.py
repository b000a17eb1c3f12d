"""Scoring of incoming rows against a fitted population, and windowed drift, in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.moments import CUTOFFS, distance, profile


def flag_outliers(stream: DataFrame, reference: DataFrame, keys: list[str], metric: str, method: str = "zscore", threshold: float | None = None) -> DataFrame:
    """Rows of a stream whose metric lies beyond the reference's bounds. The bounds are a row, broadcast to a stateless
    map: works on batches and streams alike."""
    cutoff = CUTOFFS[method] if threshold is None else threshold
    bounds = F.broadcast(profile(reference, [metric]).drop("metric_name"))
    value = F.col(metric).cast("double")
    return stream.filter(F.col(metric).isNotNull()).crossJoin(bounds).filter(distance(method, value) > cutoff).select(*keys, F.lit(metric).alias("metric_name"), value.alias("metric_value"))


def windowed_drift(stream: DataFrame, reference: DataFrame, time: str, value: str, window: str = "1 hour", lateness: str = "10 minutes", multiplier: float = 3.0) -> DataFrame:
    """Tumbling windows whose mean leaves mean +- multiplier * std / sqrt(n) of the reference; rows later than the
    watermark are dropped by the engine."""
    band = F.broadcast(reference.agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma")))
    means = stream.withWatermark(time, lateness).groupBy(F.window(time, window)).agg(F.avg(value).alias("value"), F.count(value).alias("n"))
    off = F.abs(F.col("value") - F.col("mu")) > multiplier * F.col("sigma") / F.sqrt("n")
    return means.crossJoin(band).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "value", "n", off.alias("drifted"))
