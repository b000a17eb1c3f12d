import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, queries
from plumbline.llm.ann import nearest


def brute(rows, asks, most):
    """query -> [(score, id)] best first, over the rows that count."""
    good = {}
    for k, x in rows:
        if k is not None and x and None not in x and np.isfinite(x).all() and np.any(x):
            good.setdefault(k, np.array(x, np.float64))
    width = max((len(x) for x in good.values()), default=0)
    good = {k: np.pad(x, (0, width - len(x))) for k, x in good.items()}
    return {q: sorted(((-float((x * v).sum()), k) for k, v in good.items() if k != q))[:most] for q, x in good.items() if asks(q)}


def recall(rows, expected):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    assert set(found) == set(expected)
    for q, best in expected.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, len(best) + 1)) and len({g[1] for g in got}) == len(got)
        assert [(-s, k) for _, k, s in got] == sorted((-s, k) for _, k, s in got)
        hits += len({g[1] for g in got} & {k for _, k in best})
        total += len(best)
    return hits / max(1, total)


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    expected = brute(rows, lambda k: k % 20 == 0, 20)
    found = queries.QUERIES["op9_nearest"](spark, sf_dir).collect()
    assert recall(found, expected) >= 0.99
    exact = {(q, k): -s for q, best in expected.items() for s, k in best}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12) for r in found if (r.query_id, r.vec_id) in exact)


def test_graph_search_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 24)) * rng.uniform(0.5, 2, size=(1200, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(nearest(df, F.col("vec_id") % 20 == 0).collect(), brute(rows, lambda k: k % 20 == 0, 20)) >= 0.9


def test_odd_rows(spark):
    rows = [(20, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, -5.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (40, [0.5]), (60, None), (None, [1.0, 1.0]), (2, [2.0, -5.0])]
    df = spark.createDataFrame([(k, x, 1) for k, x in rows], "vec_id long, embedding array<double>, node int")
    found = nearest(df, F.col("vec_id") % 20 == 0, most=3).collect()
    assert recall(found, brute(rows, lambda k: k % 20 == 0, 3)) == 1
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 20] == [(1, 2.0), (2, 2.0), (40, 0.5)]
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    x = np.random.default_rng(8).normal(size=(1500, 16))
    x[::3] = x[0] * 2  # more copies than a list or a leaf holds
    x[1:700:6] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest(df, F.col("vec_id") % 20 == 0).collect()
    copies = {q: best for q, best in brute(rows, lambda k: k % 20 == 0, 20).items() if q % 3 == 0}
    assert recall([r for r in found if r.query_id in copies], copies) == 1


def test_recall_over_20_000_rows(spark):
    """Half clustered, half spread evenly, norms that differ; measured against the exact inner products."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20_000, 32))
    x[::2] = rng.normal(size=(200, 32))[rng.integers(0, 200, 10_000)] + 0.3 * x[::2]
    x *= rng.uniform(0.8, 1.25, size=(20_000, 1))
    df = spark.createDataFrame(((i, v) for i, v in enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    sims = x[::20] @ x.T
    sims[np.arange(1000), np.arange(0, 20_000, 20)] = -np.inf
    best = np.argsort(-sims, axis=1)[:, :20]
    recall_ = np.mean([len(found[20 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)])
    assert len(found) == 1000 and all(len(f) == 20 for f in found.values()) and recall_ >= 0.9


def test_a_vector_alone_on_its_side(spark):
    rng = np.random.default_rng(12)
    x = np.abs(rng.normal(size=(1500, 8))) + 5
    x[40] = -x[41]
    df = spark.createDataFrame(((i, v) for i, v in enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = nearest(df, F.col("vec_id") == 40, most=40).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 41))


def test_very_long_vectors_and_clashing_names(spark):
    x = np.random.default_rng(13).normal(size=(40, 4000))
    df = spark.createDataFrame(((i, v, 1, 2, 3.0) for i, v in enumerate(x.tolist())), "vec_id long, embedding array<double>, node int, home int, score double")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = nearest(df, F.col("vec_id") % 20 == 0, most=5).collect()
    assert recall(found, brute(rows, lambda k: k % 20 == 0, 5)) == 1
