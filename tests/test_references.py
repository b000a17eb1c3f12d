"""References that a stream updates: equal to the definition over all rows, over restarts, uniform."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.plans import config as c
from plumbline.plans.workflows import run_tasks
from plumbline.streaming.references import ORDER, TIE, current, entering, ordered, updated

SCHEMA = "k long, t timestamp, x array<double>"


def batch(spark, lo, hi, shift=0):
    """Keys in a range; times run backwards within a batch, every seventh is null."""
    return spark.range(lo, hi).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.timestamp_seconds(F.lit(hi * 10 + shift) - F.col("id"))).alias("t"), F.array(F.col("id").cast("double")).alias("x"))


def run(spark, root, size, strategy):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
    rows = entering(stream, "k", size, strategy, "t", parts=4)
    query = rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(f"{root}/out")


@pytest.mark.parametrize("strategy", ["last_seen", "reservoir_sampling"])
def test_stream_survives_restarts(spark, tmp_path, strategy):
    size, parts = 50, [batch(spark, 0, 400), batch(spark, 400, 1000, -9000), batch(spark, 900, 1300)]  # late rows, keys that come again
    seen = None
    for part in parts:
        part.coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        seen = part if seen is None else seen.union(part)
        entered = run(spark, tmp_path, size, strategy)  # a new query each time, from what the last one left
        want = sorted({(r[ORDER], r[TIE], r.k) for r in ordered(seen, "k", strategy, "t").collect()})[:size]
        found = current(entered, size)
        assert sorted(r.k for r in found.collect()) == sorted(k for _, _, k in want) and found.columns == ["k", "t", "x"]
    assert entered.count() < 1300  # what enters is little beside what comes


def test_reservoir_is_uniform(spark):
    old, new = batch(spark, 0, 3000), batch(spark, 3000, 12000)
    kept = np.array([[r.k for r in updated(old, new, "k", 2000, seed=s).collect()] for s in range(3)])
    assert kept.shape == (3, 2000) and all(len(set(x)) == 2000 for x in kept.tolist())
    counts = np.array([np.bincount(x // 1000, minlength=12) for x in kept])  # 166.7 expected a thousand
    assert (((counts - 2000 / 12) ** 2 / (2000 / 12)).sum(1) < 31.3).all()  # chi square, 11 degrees, p = 0.001
    assert len(set(kept[0].tolist()) & set(kept[1].tolist())) < 500


def test_last_seen_without_times(spark):
    old, new = batch(spark, 0, 30), batch(spark, 0, 10)
    assert sorted((r.k, r.t) for r in updated(old, new.withColumn("t", F.lit(None).cast("timestamp")), "k", 4, "last_seen").collect()) == [(k, None) for k in (6, 7, 8, 9)]
    assert sorted(r.k for r in updated(old, new, "k", 12, "last_seen").collect()) == sorted([*range(10), 28, 29])
    empty = new.limit(0)
    assert updated(empty, empty, "k", 5).count() == 0 and updated(old, empty, "k", 100).count() == 30
    with pytest.raises(ValueError, match="strategy"):
        ordered(old, "k", "newest")
    with pytest.raises(ValueError, match="times"):
        ordered(old, "k", "last_seen")


def test_workflow_gives_the_updated_reference(spark, tmp_path):
    rng = np.random.default_rng(4)
    for name, n in (("a", 40), ("b", 25)):
        spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(n)], "n long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    pipeline = {
        "datasets": [{"name": n, "format": "parquet", "path": n} for n in "ab"],
        "sources": [{"name": n, "dataset": n} for n in "ab"],
        "workflows": [{"name": "w", "type": "drift-monitoring", "detectors": [{"method": "univariate"}], "update_strategy": {"type": "last_seen", "n": 30}}],
        "tasks": [{"name": "t", "workflow": "w", "sources": ["a", "b"]}],
    }
    (result,) = run_tasks(spark, c.Pipeline.model_validate(pipeline), str(tmp_path))
    assert result.success, result.errors
    assert sorted(r.n for r in result.tables["updated_reference"].collect()) == sorted([*range(25), *range(35, 40)])
    with pytest.raises(ValueError):
        c.Drift(name="w", type="drift-monitoring", detectors=[{}], update_strategy={"type": "last_seen", "n": 0})
