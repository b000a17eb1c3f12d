"""Every finding of the workflows, from small tables made to show it."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import encoding, quality
from plumbline.plans import config as c
from plumbline.plans import workflows as w
from plumbline.plans.views import build_view, positioned, selection_key
from plumbline.sources.datasets import SourceFrames


def run(workflow, params, **frames):
    out = w.Result("t")
    w.WORKFLOWS[params.type](frames, params, out)
    return out, {f.title: f for f in out.findings}


def vectors(spark, rows, label=None, shift=0.0, start=0, dims=4, seed=1):
    x = np.random.default_rng(seed).normal(size=(rows, dims)) + shift
    labels = [i % 2 for i in range(rows)] if label is None else [label] * rows
    return spark.createDataFrame([(start + i, v, l, float(i % 7)) for i, (v, l) in enumerate(zip(x.tolist(), labels))], "item_index long, embedding array<double>, class_label int, lux double")


def test_cleaning(spark):
    rows = [(i, 10.0 + i % 3, f"c{i}", f"s{i}", [float(i % 5), 1.0], i % 2) for i in range(60)] + [(60, 500.0, "c0", "s1", [90.0, 90.0], 1), (61, 11.0, "c61", "s1", [1.0, 1.0], 0)]
    items = spark.createDataFrame(rows, "item_index long, area double, content string, phash string, embedding array<double>, class_label int")
    targets = spark.createDataFrame([(i, 0, 5.0 + i % 2, i % 2) for i in range(40)] + [(40, 0, 900.0, 1)], "item_index long, target_index long, size double, class_label int")
    classes = spark.createDataFrame([(0, "car"), (1, "cat"), (2, "dog")], "class_label int, class_name string")
    p = c.Cleaning(name="x", type="data-cleaning", outlier_method="zscore", metrics=["area"], content="content", near_signatures=["phash"], target_metrics=["size"], embedding="embedding", outlier_cluster_threshold=3.0, outlier_n_clusters=2, mode="preparatory")
    out, found = run("data-cleaning", p, a=SourceFrames(items, targets, classes))
    assert found["Image Outliers"].severity == "info" and found["Image Outliers"].data["by_metric"]["area"] == 1
    assert found["Target Outliers"].data == {"count": 1, "percent": 2.4} and found["Target Outliers"].severity == "info"
    assert found["Classwise Outliers"].data["worst_class"] == "1"
    assert found["Duplicates"].severity == "warning" and found["Duplicates"].data == {"exact_percent": 1.6, "near_percent": 3.2}
    assert found["Label Distribution"].severity == "warning" and found["Label Distribution"].data["missing"] == ["dog"]
    assert out.tables["clean_indices"].count() == 62 - out.scalars["removed"] == 60
    p = p.model_copy(update={"duplicate_merge_near": False, "content": None, "metrics": ["area"], "outlier_cluster_threshold": None})
    out, found = run("data-cleaning", p, a=SourceFrames(items.filter("item_index < 60")))
    assert "Duplicates" not in found and "Target Outliers" not in found and found["Image Outliers"].severity == "ok"
    with pytest.raises(ValueError, match="embedding"):
        c.Cleaning(name="x", type="data-cleaning", outlier_method="iqr", metrics=["a"], outlier_cluster_threshold=1.0)


def test_analysis(spark):
    one = vectors(spark, 60).withColumn("text", F.concat(F.lit("t"), "item_index")).withColumn("told", F.col("class_label").cast("string"))
    two = vectors(spark, 60, label=1, shift=9.0, seed=2).withColumn("text", F.concat(F.lit("t"), "item_index")).withColumn("told", F.lit("z"))
    p = c.Analysis(name="x", type="data-analysis", outlier_method="iqr", metrics=["lux"], factors=["told"], balance=True, include_metrics=True, diversity_method="shannon", content="text", embedding="embedding", divergence_method="fnn")
    out, found = run("data-analysis", p, a=SourceFrames(one), b=SourceFrames(two))
    assert found["Image Quality: a"].severity == "ok" and found["Label Balance: a"].severity == "ok" and "Redundancy: a" not in found
    assert found["Bias: a"].severity == "warning" and found["Bias: a"].data["factors_told_by_label"] == {"told": 1.0}
    assert found["Label Overlap: a vs b"].severity == "warning" and found["Label Parity: a vs b"].data["significant"]
    assert found["Leakage: a vs b"].severity == "warning" and out.tables["a_vs_b.leaked_items"].count() == 120
    assert found["Shift: a vs b"].severity == "warning" and found["Shift: a vs b"].data["level"] == "high"
    assert {r.factor for r in out.tables["a.diversity"].collect()} == {"told", "lux"}
    out, found = run("data-analysis", p.model_copy(update={"divergence_method": "mst", "content": None}), a=SourceFrames(one), b=SourceFrames(vectors(spark, 60, seed=3).withColumn("told", F.lit("z"))))
    assert found["Shift: a vs b"].severity == "ok" and "Leakage: a vs b" not in found


def test_coverage(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(80, 3)), rng.normal(size=(40, 3)) * 0.01, [[50.0, 50, 50]]])
    rows = [(i, v, "cat" if i < 80 else "dog" if i < 120 else "car", "day" if i % 2 else "night") for i, v in enumerate(x.tolist())]
    items = spark.createDataFrame(rows, "item_index long, embedding array<double>, class_label string, light string")
    tree = {"animal": {"cat": None, "dog": None, "cow": None}, "thing": {"bus": None}}
    p = c.Coverage(name="x", type="data-coverage", factors=["light"], ontology=tree)
    out, found = run("data-coverage", p, a=SourceFrames(items))
    assert found["Embedding Coverage"].severity == "warning" and found["Embedding Coverage"].data["clustered"] == ["dog"]
    assert found["Completeness"].severity == "warning" and out.tables["nearest_pairs"].first().dist < 0.1
    assert found["Label Distribution"].severity == "warning"  # 80 to 1
    assert found["Metadata Gaps"].severity == "ok"
    assert found["Label Space"].severity == "warning" and found["Label Space"].data["dark_branches"] == ["thing"]
    assert found["Conformance"].data["unmatched"] == [{"class_name": "car", "matches": 0, "verdict": "none"}] and found["Conformance"].severity == "warning"
    assert found["Structure"].severity == "info" and found["Structure"].data["max_depth"] == 1 and "Class Balance" not in found
    out, found = run("data-coverage", p.model_copy(update={"ontology": None, "run_completeness": False}), a=SourceFrames(items))
    assert found["Class Balance"].severity == "info" and "Label Space" not in found and "Completeness" not in found
    out, found = run("data-coverage", p.model_copy(update={"ontology": "/nowhere.nt"}), a=SourceFrames(items))
    assert "nowhere" in out.scalars["ontology_skipped"] and "Label Space" not in found
    gappy = items.withColumn("light", F.when(F.col("class_label") == "cat", "day").otherwise("night"))
    assert run("data-coverage", p, a=SourceFrames(gappy))[1]["Metadata Gaps"].severity in ("info", "warning")


def test_splitting(spark):
    out, found = run("data-splitting", c.Splitting(name="x", type="data-splitting", embedding="embedding"), a=SourceFrames(vectors(spark, 200)))
    assert found["Class Distribution"].severity == "ok" and found["Stratification"].severity == "ok" and found["Coverage"].severity == "ok"
    uneven = vectors(spark, 200).withColumn("class_label", F.when(F.col("item_index") < 10, 0).otherwise(1))
    assert run("data-splitting", c.Splitting(name="x", type="data-splitting"), a=SourceFrames(uneven))[1]["Class Distribution"].severity == "warning"


@pytest.mark.parametrize("test", ["ks", "cvm", "mwu", "anderson", "bws"])
def test_each_univariate_test_flags_a_shift(spark, test):
    p = c.Drift(name="x", type="drift-monitoring", detectors=[{"test": test}])
    reference = SourceFrames(vectors(spark, 80))
    assert run("drift-monitoring", p, a=reference, b=SourceFrames(vectors(spark, 60, shift=100.0, seed=2)))[1]["Drift: univariate"].severity == "warning"
    assert run("drift-monitoring", p, a=reference, b=SourceFrames(vectors(spark, 60, seed=3)))[1]["Drift: univariate"].severity == "ok"


def test_drift_by_chunks_and_classes(spark):
    reference = vectors(spark, 200)
    test = vectors(spark, 100, seed=2).union(vectors(spark, 100, label=1, shift=5.0, start=100, seed=3))
    p = c.Drift(name="x", type="drift-monitoring", detectors=[{"chunking": {"chunk_size": 20}, "classwise": True}, {"method": "knn", "classwise": True}, {"method": "mmd", "n_permutations": 30}, {"method": "mmd", "n_permutations": 20}, {"method": "domain_classifier", "n_folds": 2}])
    out, found = run("drift-monitoring", p, a=SourceFrames(reference), b=SourceFrames(test))
    assert not out.errors and {"Drift: mmd_1", "Drift: mmd_2", "Drift: domain_classifier"} <= set(found)
    chunked = found["Chunked Drift: univariate"]
    assert chunked.severity == "warning" and chunked.data["longest_run"] >= 5 and chunked.data["percent_drifted"] >= 50.0
    assert found["Classwise Drift: univariate"].data == {"drifted": ["1"], "skipped": []} and found["Classwise Drift: knn"].data["drifted"] == ["1"]
    out, found = run("drift-monitoring", p.model_copy(update={"drift_warning": False, "detectors": [{"chunking": {"chunk_count": 4}, "classwise": True}]}), a=SourceFrames(reference), b=SourceFrames(reference))
    assert found["Drift: univariate"].severity == found["Classwise Drift: univariate"].severity == "ok"
    assert found["Chunked Drift: univariate"].severity in ("ok", "info")


def test_ood(spark):
    test = vectors(spark, 40, seed=2).union(vectors(spark, 8, shift=30.0, start=40, seed=3).withColumn("lux", F.lit(70.0)))
    p = c.Ood(name="x", type="ood-detection", detectors=[{"k": 5, "metric": "euclidean"}, {"method": "domain_classifier", "n_folds": 2, "n_repeats": 2}], factors=["lux"], max_ood_insights=3)
    out, found = run("ood-detection", p, a=SourceFrames(vectors(spark, 100)), b=SourceFrames(test))
    assert found["Out of Distribution"].severity == "warning" and set(found["Out of Distribution"].data["detectors"]) == {"knn", "domain_classifier"}
    assert {r.item_index for r in out.tables["consensus"].filter("mutual").collect()} >= set(range(40, 48))
    assert out.tables["factor_deviations"].count() == 3 and out.tables["factor_deviations"].agg(F.min("deviation")).first()[0] > 5
    assert out.tables["factor_predictors"].first().mi_bits > 0.3
    assert w.usable_factors(test, test.withColumn("flat", F.lit(1.0)), ["lux", "flat", "embedding"]) == ["lux"]


@pytest.mark.parametrize("method", ["knn", "kmeans_distance", "kmeans_complexity"])
def test_prioritization(spark, method):
    known = vectors(spark, 60).withColumn("text", F.concat(F.lit("r"), "item_index"))
    pool = vectors(spark, 40, seed=2, start=100).withColumn("text", F.concat(F.lit("p"), F.col("item_index") % 20)).union(vectors(spark, 1, shift=40.0, start=200).withColumn("text", F.lit("far")))
    p = c.Prioritization(name="x", type="data-prioritization", method=method, cleaning=c.PriorCleaning(content="text"))
    out, found = run("data-prioritization", p, a=SourceFrames(known), b=SourceFrames(pool))
    assert found["Pruning"].severity == "warning" and found["Pruning"].data["cleaned_size"] == 21
    rows = sorted(out.tables["prioritized"].collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 22)) and rows[0].item_index == 200 and all(a.score >= b.score for a, b in zip(rows, rows[1:]))


def test_sweep(spark):
    items = vectors(spark, 100).withColumn("text", F.lit("same")).withColumn("sig", F.col("item_index") % 90)
    p = c.Sweep(name="x", type="parameter-sweep", metrics=["lux"], embedding="embedding", outlier_method=["zscore", "iqr"], outlier_threshold=[None, 1.0], outlier_cluster_threshold=[1.0, 2.0], outlier_n_clusters=3, content="text", near_signatures=["sig"], duplicate_cluster_sensitivity=[0.2, 1.0], duplicate_merge_near=[True, False])
    out, found = run("parameter-sweep", p, a=SourceFrames(items))
    rows = {(r["kind"], r["method"], r["threshold"]): r["n"] for r in found["Sweep"].data}
    assert len(rows) == 4 + 2 + 1 + 4 and rows["exact_duplicates", "content", None] == 99
    assert rows["cluster_outliers", "kmeans", 1.0] >= rows["cluster_outliers", "kmeans", 2.0] and rows["near_duplicates", "merged", 1.0] >= rows["near_duplicates", "merged", 0.2] >= 10


def test_reference_split_descriptor_and_frames_in_memory(spark, tmp_path):
    bins = {"name": "b", "continuous_factor_bins": {"lux": 3}, "reference_split": "a"}
    raw = {
        "datasets": [{"name": "one", "path": "x"}, {"name": "two", "path": "y"}], "sources": [{"name": "a", "dataset": "one"}, {"name": "b", "dataset": "two"}], "metadata": [bins],
        "workflows": [{"name": "s", "type": "data-splitting"}], "tasks": [{"name": "t", "workflow": "s", "sources": ["a", "b"], "metadata": "b"}],
    }
    frames = {"one": SourceFrames(vectors(spark, 50)), "two": SourceFrames(vectors(spark, 50).withColumn("lux", F.col("lux") * 100))}
    (result,) = w.run_tasks(spark, c.Pipeline.model_validate(raw), frames=frames)
    assert result.success and "METADATA FACTORS" in result.report() and "CONFIGURATION" in result.report()
    (tmp_path / "encoding.json").write_text(result.descriptor)
    policy = w.policy_of(c.MetadataPolicy(name="p", encoding="encoding.json"), frames["one"].items, str(tmp_path))
    with pytest.raises(ValueError, match="derived"):
        w.policy_of(c.MetadataPolicy(name="p", strict=True, encoding="encoding.json"), frames["one"].items, str(tmp_path))
    assert policy.digest() == encoding.from_descriptor(result.descriptor).digest() == json.loads(result.descriptor)["encoding_digest"]
    sources, _ = w.bind(spark, c.Task(name="t", workflow="s", sources=["a", "b"], metadata="b"), c.Pipeline.model_validate(raw), ".", frames)
    assert sources["b"].items.filter("lux > 6").agg(F.min("lux_code"), F.max("lux_code")).first() == (3, 3)  # coded by the reference's edges
    raw["metadata"] = [bins | {"reference_split": "nope"}]
    assert not w.run_tasks(spark, c.Pipeline.model_validate(raw), frames=frames)[0].success


def test_selection_keys(spark):
    df = spark.range(50).withColumnRenamed("id", "item_index")
    one, two = (selection_key(build_view(df.repartition(n), [{"type": "Shuffle", "params": {"seed": 3}}, {"type": "Limit", "params": {"size": 20}}], "item_index"), "item_index") for n in (1, 3))
    assert one == two != selection_key(positioned(df, "item_index"), "item_index") and one.startswith("sel:n=20:")


def test_sweep_shuffles_a_row_a_key_beyond_the_least_threshold(spark):
    rows = [(i // 2, float(i % 7), None if i % 3 else float(i)) for i in range(200)] + [(500, 90.0, 1e4), (500, 95.0, None), (501, None, None)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    found = quality.outlier_sweep(df, ["k"], ["a", "b"], ["zscore", "modzscore"], [3.5, 2.0])
    got = {(r.method, r.threshold): r.outlier_count for r in found.collect()}
    wanted = {(m, t): quality.outlier_issues(df, ["k"], ["a", "b"], m, t).select("k").distinct().count() for m in ("zscore", "modzscore") for t in (3.5, 2.0)}
    assert got == wanted and max(wanted.values()) > 0
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row a metric and combination
    assert quality.outlier_sweep(df.limit(0), ["k"], ["a"], ["zscore"], [1.0]).count() == 0
