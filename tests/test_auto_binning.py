import json
import math

import numpy as np
import pytest

from plumbline.operators import encoding
from plumbline.plans import config as c
from plumbline.plans.workflows import run_tasks
from plumbline.sources.datasets import SourceFrames


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal(50, 9)), float(rng.integers(0, 4)), 7.0, None if i % 9 else float(i), math.nan if i % 50 == 0 else float(rng.exponential(3)), "ab"[i % 2], i % 3, [1.0]) for i in range(500)]
    return spark.createDataFrame(rows, "item_index long, elevation double, grade double, flat double, rare double, skewed double, sensor string, class_label int, embedding array<double>")


FACTORS = ["elevation", "grade", "flat", "rare", "skewed"]


def values(table, f):
    x = np.array([r[0] for r in table.select(f).collect() if r[0] is not None])
    return x[~np.isnan(x)]


@pytest.mark.parametrize("method", ["uniform_width", "uniform_count", "clusters"])
def test_bins_of_all_factors_by_the_rule(table, method):
    found = encoding.auto_bins(table, FACTORS, method)
    assert all(b.provenance == "derived" and b.method == method and b.edges[0] == -math.inf and b.edges[-1] == math.inf for b in found.values())
    for f in FACTORS:
        x = values(table, f)
        q1, q3 = np.quantile(x, [0.25, 0.75])
        width = 2 * (q3 - q1) / len(x) ** (1 / 3)
        k = max(2, min(64, math.ceil((x.max() - x.min()) / width) if width else math.ceil(math.log2(len(x))) + 1))
        if method == "uniform_width":
            wanted = np.linspace(x.min(), x.max(), k + 1)[1:-1] if x.max() > x.min() else []
            assert np.allclose(found[f].edges[1:-1], wanted)
        elif method == "uniform_count":
            edges = np.quantile(x, np.arange(k + 1) / k)
            wanted = sorted(set(np.round(edges[1:-1], 9)) - set(np.round(edges[[0, -1]], 9)))
            assert np.allclose(found[f].edges[1:-1], wanted)
        else:
            assert 1 <= found[f].count <= k
    assert found["flat"].count == 1 and encoding.auto_bins(table.limit(0), ["elevation"], method)["elevation"].count == 1


def test_counts_at_exact_quantiles_keep_ties_together(table):
    codes = table.select("grade", encoding.uniform_count(table, "grade", 3).code(table["grade"]).alias("code")).distinct().collect()
    assert len(codes) == len({r.grade for r in codes})


def test_record_says_what_was_asked_and_what_was_done(spark, table):
    bins = encoding.Bins((0.0, 45.0, 60.0), "declared")
    policy = encoding.Policy({"elevation": bins, "sensor": encoding.Levels(("a", "b", "c")), **encoding.auto_bins(table, ["skewed"])}, ("rare",))
    record = encoding.binning_record(table, policy, {"elevation": [0.0, 45.0, 60.0], "altitude": 4})
    x = values(table, "elevation")
    parts = [x[(x >= 0) & (x < 45)], x[(x >= 45) & (x <= 60)]]
    assert [(r["code"], r["name"], r["count"], r["min"], r["max"]) for r in record["factors"]["elevation"]["fit"]] == [(i + 1, n, len(p), p.min(), p.max()) for i, (n, p) in enumerate(zip(bins.names(), parts))]
    assert record["factors"]["elevation"]["above"] == (x > 60).sum() and record["factors"]["elevation"]["below"] == 0 and record["factors"]["skewed"]["missing"] == 10
    assert [(r["name"], r["count"]) for r in record["factors"]["sensor"]["fit"]] == [("a", 250), ("b", 250), ("c", 0)]
    assert record["unreviewed"] == ["skewed"] and record["unmatched_bin_requests"] == ["altitude"] and record["excluded"] == ["rare"] and record["dropped"] == {"embedding": ["array<double>"]}
    assert record["requested_bins"] == {"elevation": [0.0, 45.0, 60.0], "altitude": 4} and record["encoding_digest"] == policy.digest()
    json.dumps(record, allow_nan=False)


def test_a_task_bins_what_its_workflow_reads(spark, table):
    raw = {
        "datasets": [{"name": "d", "path": "x"}], "sources": [{"name": "s", "dataset": "d"}], "metadata": [{"name": "open", "continuous_factor_bins": {"grade": 2, "gone": 3}, "exclude": ["flat"]}, {"name": "shut", "strict": True, "factor_levels": {"sensor": ["a", "b"]}}],
        "workflows": [{"name": "w", "type": "data-analysis", "outlier_method": "iqr", "metrics": ["elevation"], "factors": ["elevation", "sensor", "grade"]}],
        "tasks": [{"name": "t", "workflow": "w", "sources": "s", "metadata": "open"}, {"name": "u", "workflow": "w", "sources": "s", "metadata": "shut"}],
    }
    raw["metadata"][0]["continuous_factor_bins"].pop("gone")
    one, two = run_tasks(spark, c.Pipeline.model_validate(raw), frames={"d": SourceFrames(table)})
    assert one.success and two.success, (one.errors, two.errors)
    record = one.envelope["metadata_binning"]
    assert set(record["factors"]) == {"elevation", "grade"} and record["unreviewed"] == ["elevation", "grade"] and record["factors"]["grade"]["encoding"]["method"] == "uniform_width"
    assert record["requested_bins"] == {"grade": 2} and set(two.envelope["metadata_binning"]["factors"]) == {"sensor"} and two.envelope["metadata_binning"]["unreviewed"] == []
