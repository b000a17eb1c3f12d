import math
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
from plumbline.operators import neighbors, shift
from plumbline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that SQL can't state; each is checked against its own definition below.
UNSTATED = {"drift_mmd", "divergence_mst", "cluster_outliers", "domain_classifier_drift", "ood_domain_classifier", "prioritize_kmeans", "balance_adjusted",
            "hdbscan_clusters", "cluster_outliers_hdbscan", "cluster_duplicates", "prioritize_hdbscan"}  # these in tests/test_density.py


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, sql, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert name in UNSTATED  # has a test of its own below
        return
    expected = sql.sql(catalog.ORACLES[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(rows, key=key) == sorted((tuple(r[i] for i in places) for r in expected.fetchall()), key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["class_name", "outlier_count", "pct"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


def test_drift_mmd(spark, sf_dir, vectors):
    ids, x = vectors
    row = catalog.QUERIES["drift_mmd"](spark, sf_dir).first()
    assert row.mmd2 == pytest.approx(shift.mmd2(x[ids % 4 != 0], x[ids % 4 == 0])[0], abs=1e-9) and 0 < row.p_val <= 1 and row.drifted == (row.p_val < 0.05)


def test_divergence_mst(spark, sf_dir, vectors):
    ids, x = vectors
    a, b = neighbors._tree(neighbors.squared_distances(x, x))
    side = ids % 4 == 0
    m, n = (~side).sum(), side.sum()
    assert catalog.QUERIES["divergence_mst"](spark, sf_dir).first()[0] == pytest.approx(max(0.0, 1 - (side[a] != side[b]).sum() * (m + n) / (2 * m * n)))


def test_cluster_outliers(spark, sf_dir, vectors):
    """From the clusters it reports: each flagged row lies beyond its cluster's mean and 1.5 deviations, no other does."""
    from plumbline.operators.quality import cluster_distances

    ids, x = vectors
    placed = cluster_distances(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 10).collect()
    by = {}
    for r in placed:
        by.setdefault(r.cluster_id, {})[r.vec_id] = r.metric_value
    at = dict(zip(ids.tolist(), x))
    wanted = set()
    for members in by.values():
        d = np.array(list(members.values()))
        wanted |= {k for k, v in members.items() if len(d) > 1 and v > d.mean() + 1.5 * d.std() + 1e-12}
        centre = np.mean([at[k] for k in members], 0)
        assert all(abs(np.linalg.norm(at[k] - centre) - v) < 1e-6 for k, v in members.items())
    assert {r.vec_id for r in catalog.QUERIES["cluster_outliers"](spark, sf_dir).collect()} == wanted and sum(map(len, by.values())) == len(ids)


def test_domain_classifiers(spark, sf_dir, vectors):
    """AUROC and thresholds from the out-of-fold probabilities, which only rows of other folds gave."""
    ids, _ = vectors
    reference, test = catalog._populations(spark, sf_dir)
    auroc, _, scored = shift.domain_classifier(reference, test, "vec_id", "embedding")
    rows = scored.collect()
    p, y = np.array([r.probability for r in rows]), np.array([r.label for r in rows]) == 1
    assert sorted(r.vec_id for r in rows) == ids.tolist() and (y == (np.array([r.vec_id for r in rows]) % 4 == 0)).all()
    pairs = (p[y][:, None] > p[~y][None, :]).mean() + (p[y][:, None] == p[~y][None, :]).mean() / 2
    row = catalog.QUERIES["domain_classifier_drift"](spark, sf_dir).first()
    assert row.auroc == pytest.approx(auroc) == pytest.approx(pairs, abs=1e-6) and row.drifted == (row.auroc > 0.55)
    two = {r.vec_id: (r.label, r.probability) for r in shift.domain_classifier(reference, test, "vec_id", "embedding", folds=5, repeats=5)[2].collect()}
    own = np.array([q for label, q in two.values() if label == 0])
    found = catalog.QUERIES["ood_domain_classifier"](spark, sf_dir).collect()
    assert {r.vec_id for r in found} == {k for k, (label, _) in two.items() if label == 1}
    for r in found:
        assert r.score == pytest.approx(two[r.vec_id][1]) and r.threshold == pytest.approx(own.mean() + 2 * own.std()) and r.is_ood == (r.score > r.threshold)


def test_prioritize_kmeans(spark, sf_dir, vectors):
    rows = sorted(catalog.QUERIES["prioritize_kmeans"](spark, sf_dir).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, len(rows) + 1)) and {r.vec_id for r in rows} == {int(i) for i in vectors[0] if i % 4 == 0}
    assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)


def test_balance_adjusted(spark, sf_dir):
    """Against permutations: chance alone gives about the mutual information that is taken off."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    rng = np.random.default_rng(1)

    def mi(x, y):
        n, a, b, c = len(x), Counter(x), Counter(y), Counter(zip(x, y))
        return sum(k / n * math.log(k * n / (a[i] * b[j])) for (i, j), k in c.items())

    def entropy(x):
        return -sum(k / len(x) * math.log(k / len(x)) for k in Counter(x).values())

    for r in catalog.QUERIES["balance_adjusted"](spark, sf_dir).collect():
        x, y = ([p[c] for p in parts] for c in (r.x_name, r.y_name))
        chance = np.mean([mi(x, [y[i] for i in rng.permutation(len(y))]) for _ in range(60)])
        mean = (entropy(x) + entropy(y)) / 2
        assert r.ami == pytest.approx((mi(x, y) - chance) / (mean - chance), abs=0.03)


def test_p_values_at_published_points(spark):
    """Critical values of the limits at 10, 5 and 1 percent."""
    text = {"cvm": (shift.cvm_p, (0.34730, 0.46136, 0.74346)), "ad": (shift.ad_p, (1.933, 2.492, 3.878)), "normal": (shift.normal_p, (1.6449, 1.95996, 2.57583))}
    for f, points in text.values():
        rows = spark.createDataFrame([(float(x),) for x in points], "x double").selectExpr(f"{f('x')} as p").collect()
        assert [r.p for r in rows] == pytest.approx([0.1, 0.05, 0.01], rel=0.01)
    rows = spark.range(1, 4000).selectExpr("id / 100.0D as x").selectExpr(f"{shift.ad_p('x')} as a", f"{shift.cvm_p('x')} as c").collect()
    for c in "ac":
        values = [r[c] for r in rows]
        assert all(0 <= v <= 1 for v in values) and all(a >= b - 1e-5 for a, b in zip(values, values[1:]))
