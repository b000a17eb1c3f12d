import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import quantiles
from plumbline.functions.moments import profile
from plumbline.functions.ordering import numbered, renumbered
from plumbline.functions.quantiles import exact_quantiles, quantile
from plumbline.operators import ontology, quality, shift

POINTS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize("small", [20_000, 100])
def test_quantiles_are_exact(spark, monkeypatch, small):
    """Skewed, tied, constant and single values, with brackets over everything and from the sketch."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = np.random.default_rng(1)
    groups = {"skewed": np.exp(rng.normal(size=30_000) * 4), "tied": rng.integers(0, 5, 20_000).astype(float), "constant": np.full(3000, 2.5), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "wide": np.concatenate([rng.normal(size=5000), [1e300, -1e300]])}
    frame = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("one", None), (None, 3.0)], "g string, v double").repartition(7)
    found = {r.g: r for r in exact_quantiles(frame, "g", "v", POINTS).collect()}
    assert set(found) == set(groups)
    for g, x in groups.items():
        assert found[g].n == len(x) and found[g].q == pytest.approx(np.quantile(x, POINTS), rel=1e-12, abs=1e-300), g
    assert quantile(frame.limit(0), "v", [0.5]).first().q is None


def test_profiles_hold_what_a_method_needs(spark):
    x = np.random.default_rng(2).normal(size=500) ** 3
    df = spark.createDataFrame([(float(v), None) for v in x], "a double, b double")
    row = {r.metric_name: r for r in profile(df, ["a", "b"]).collect()}
    mad = np.median(np.abs(x - np.median(x)))
    assert (row["a"].mean, row["a"].std, row["a"].mad, row["a"].mead) == pytest.approx((x.mean(), x.std(), mad, np.abs(x - np.median(x)).mean()))
    assert row["b"].mean is None and row["b"].q is None
    assert profile(df, ["a"], ["zscore"]).first().q is None and profile(df, ["a"], ["iqr"]).first().mean is None


@pytest.mark.parametrize("descending", [False, True])
def test_positions_in_two_levels(spark, descending):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 50 == 0 else float(rng.choice([rng.normal(), 1.0, 1.0]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    found = sorted((r.p, r.k) for r in numbered(df, "v", "k", "p", descending).collect())
    wanted = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
    assert found == [(i + 1, k) for i, (k, _) in enumerate(wanted)]
    gaps = df.filter("k % 3 = 0").withColumnRenamed("k", "p")
    found = sorted((r.p, r.v) for r in renumbered(gaps, "p", descending, width=16).collect() if r.v is not None)
    order = sorted((r for r in rows if r[0] % 3 == 0), key=lambda r: -r[0] if descending else r[0])
    assert found == [(i, v) for i, (_, v) in enumerate(order) if v is not None]
    assert numbered(df.limit(0), "v", "k", "p").count() == 0


def test_pooled_counts_in_parts(spark):
    """Cumulative counts over parts equal those over all values at once."""
    rng = np.random.default_rng(4)
    rows = [(d, float(v), int(t)) for d in range(2) for v, t in zip(rng.choice([rng.normal(size=900).round(2), np.zeros(900)][d], 2000), rng.integers(0, 2, 2000))]
    df = spark.createDataFrame(rows, "dim int, v double, is_test int")
    for r in shift.pooled(df, ["dim"]).collect():
        own = [(v, t) for d, v, t in rows if d == r.dim]
        assert (r.cr, r.ct) == (sum(v <= r.v and not t for v, t in own), sum(v <= r.v and t for v, t in own)) and r.m + r.n == len(own)
    assert shift.ks(df.select("v", "is_test"), []).count() == 1


def test_members_of_leaks_and_groups(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, None, "x"), (6, None, "y"), (7, "c", "y")], "k long, t string, split string")
    assert sorted(tuple(r) for r in quality.exact_duplicates(df, "k", "t").collect()) == [(1, 1, 2), (1, 2, 2), (3, 3, 2), (3, 4, 2)]
    assert sorted((r.split, r.k) for r in quality.leaked_members(df, "k", "t", "split").collect()) == [("x", 3), ("y", 4)]


def test_names_that_two_concepts_share(spark):
    edges = spark.createDataFrame([("root", None), ("bank1", "root"), ("bank2", "root"), ("river", "root")], "child string, parent string")
    concepts = spark.createDataFrame([("bank1", "bank"), ("bank2", "bank"), ("river", "river"), ("root", None)], "concept string, label string")
    names = spark.createDataFrame([("bank",), ("river",), ("sea",), ("river",)], "class_name string")
    found = {r.class_name: (r.matches, r.verdict) for r in ontology.resolve(names, edges, concepts).collect()}
    assert found == {"bank": (2, "ambiguous"), "river": (1, "one"), "sea": (0, "none")}
    assert {r.class_name: r.verdict for r in ontology.resolve(names, edges).collect()} == {"bank": "none", "river": "one", "sea": "none"}


def test_lint_of_siblings_and_outer_ancestors(spark):
    edges = spark.createDataFrame([("a", "top"), ("b", "a"), ("b", "top"), ("c", "outside")], "child string, parent string")
    found = {(r.finding, r.node) for r in ontology.lint(edges.union(spark.createDataFrame([("top", None)], "child string, parent string"))).collect()}
    assert {("ancestor_sibling", "a"), ("redundant_edge", "b"), ("external_ancestor", "outside"), ("unary_parent", "a")} <= found and ("external_ancestor", "top") not in found
    cyclic = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        ontology.closure(cyclic)
    assert ontology.flat(spark.createDataFrame([("x",)], "n string")).filter(F.col("parent").isNotNull()).count() == 1
