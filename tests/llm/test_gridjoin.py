import numpy as np
import pytest

from plumbline.llm import gridjoin, queries
from plumbline.llm.gridjoin import interval_join, near_vectors, principal_axes, projected, split_order


def brute(rows, least):
    good = [i for i, (k, x, l) in enumerate(rows) if k is not None and l is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for n, i in enumerate(good):
        for j in good[:n]:
            (_, x, a), (_, y, b) = rows[i], rows[j]
            if a == b and len(x) == len(y):
                x, y = np.array(x, np.float64), np.array(y, np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((find(i), find(j)), key=lambda v: rows[v][0])
                    root[q] = p
    return sorted(((k, links[i], rows[find(i)][0], k is None or rows[find(i)][0] == k) for i, (k, _, _) in enumerate(rows)), key=str)


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.QUERIES["op7_embedding_dedup"](spark, sf_dir).collect()), key=str) == brute(rows, 0.93)


@pytest.mark.parametrize(("block", "leaf"), [(512, 128), (7, 3)])
def test_blocks_and_odd_rows(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(gridjoin, "BLOCK", block)
    monkeypatch.setattr(gridjoin, "LEAF", leaf)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.6])).astype(np.float32).tolist(), int(i % 3) if i % 17 else None) for i in range(150)]
    rows += [(200 + i, rows[4][1], 1) for i in range(5)] + [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] + rows[4][1][1:], 1), (304, [None] + rows[4][1][1:], 1), (305, [float("inf")] * 16, 1), (306, rows[4][1][:9], 1), (307, rows[4][1][:9], 1), (None, rows[4][1], 1), rows[5]]
    df = spark.createDataFrame([(k, x, l, 1.0) for k, x, l in rows], "vec_id long, embedding array<float>, label int, p double")
    assert sorted(map(tuple, near_vectors(df).collect()), key=str) == brute(rows, 0.93)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_interval_join_is_exact():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = projected(x, principal_axes(x))
    order = split_order(p)
    assert sorted(order.tolist()) == list(range(700))
    x, p = x[order], p[order]
    i, j, compared = interval_join(x, x, p, p, 0.93, True)
    expected = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == list(map(tuple, expected.tolist())) and compared <= 700 * 700


def test_one_key_in_two_labels(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 2), (8, [1.0, 0.01], 1), (9, [0.01, 1.0], 2), (5, [0.0, 1.0], 2), (7, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, near_vectors(df).collect())) == brute(rows, 0.93)


def test_keys_of_text_and_long_vectors(spark):
    x = np.random.default_rng(2).normal(size=3000)
    rows = [("b", x.tolist(), 1), ("a", (2 * x).tolist(), 1), ("c", (-x).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")
    assert sorted(map(tuple, near_vectors(df).collect())) == brute(rows, 0.93)


def test_clusters_are_skipped(spark):
    """Report: of clustered vectors most pairs are never compared; links are those of brute force."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(10, 24))
    rows = [(i, (centres[i % 10] + rng.normal(size=24) * 0.1).tolist(), 1) for i in range(1000)]
    report = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = near_vectors(df, report=report).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 0.93)
    assert report["possible"] == 1000 * 999 / 2 and report["compared"] < report["possible"] / 2
