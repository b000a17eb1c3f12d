"""Embeddings, clusters and scores are kept: a second run computes none, a changed view only what hangs on it."""

import numpy as np
import pytest

from plumbline.operators import density, embedding
from plumbline.plans import config as c
from plumbline.plans.workflows import run_tasks
from plumbline.sources.datasets import from_samples

CLEAN = {"name": "w", "type": "data-cleaning", "outlier_method": "zscore", "embedding": "embedding", "outlier_cluster_threshold": 1.5, "duplicate_cluster_sensitivity": 0.2, "metrics": ["n"]}


@pytest.fixture
def vectors(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(at, 0.2, (30, 2)) for at in (0, 5)])
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "n long, embedding array<double>, class_label int").coalesce(1).write.parquet(f"{tmp_path}/d")
    return tmp_path


def config(*operations, **more):
    return c.Pipeline.model_validate({
        "datasets": [{"name": "d", "format": "parquet", "path": "d"}], "views": [{"name": "v", "operations": list(operations)}], "sources": [{"name": "s", "dataset": "d", "view": "v"}],
        "workflows": [{**CLEAN, **more}], "tasks": [{"name": "t", "workflow": "w", "sources": "s"}],
    })


def test_clusters_are_kept(spark, vectors, monkeypatch):
    computed = []
    for module, name in ((density, "hdbscan"), (density, "density_distances"), (density, "cluster_duplicates")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: (computed.append(_n), _f(*a, **k))[1])

    def run(pipeline):
        computed.clear()
        (result,) = run_tasks(spark, pipeline, str(vectors), cache=f"{vectors}/kept")
        assert result.success, result.errors
        return [(f.title, f.data) for f in result.findings], set(computed)

    first, made = run(config())
    assert made == {"density_distances", "hdbscan", "cluster_duplicates"}
    assert run(config()) == (first, set())  # from the tables
    relabelled, made = run(config({"type": "Relabel", "params": {"map": {"0": 1}}}))
    assert made == set()  # labels aren't what clusters are made of
    _, made = run(config(duplicate_cluster_sensitivity=0.3))
    assert made == {"cluster_duplicates"}  # the clusters stay
    _, made = run(config({"type": "Limit", "params": {"size": 45}}))
    assert made == {"density_distances", "hdbscan", "cluster_duplicates"}


def test_embeddings_are_kept(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    frames = {"d": from_samples(spark, [(rng.integers(0, 255, (6, 6)), i % 2) for i in range(12)], ["a", "b"])}
    computed = []
    monkeypatch.setattr(embedding, "flattened", lambda *a, _f=embedding.flattened, **k: (computed.append(1), _f(*a, **k))[1])

    def run(*operations):
        computed.clear()
        pipeline = c.Pipeline.model_validate({
            "datasets": [{"name": "d", "path": "-"}], "views": [{"name": "v", "operations": list(operations)}], "sources": [{"name": "s", "dataset": "d", "view": "v"}],
            "extractors": [{"name": "flat", "model": "flatten"}], "workflows": [{"name": "w", "type": "data-splitting", "test_frac": 0.25}], "tasks": [{"name": "t", "workflow": "w", "sources": "s", "extractor": "flat"}],
        })
        (result,) = run_tasks(spark, pipeline, frames=frames, cache=str(tmp_path))
        assert result.success, result.errors
        return len(computed)

    assert [run(), run(), run({"type": "Reverse"}), run({"type": "Limit", "params": {"size": 5}})] == [1, 0, 0, 1]
