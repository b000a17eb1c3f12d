import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import encoding, labels, neighbors, ontology, quality, shift, splitting
from plumbline.plans import views

TREE = {"subject": {"vehicle": {"wheeled": ["car", "truck"]}, "animal": {"mammal": ["cat", "dog"], "amphibian": ["frog"]}}}


@pytest.fixture(scope="module")
def edges(spark):
    return ontology.from_mapping(spark, TREE).cache()


def counts(spark, **n):
    return spark.createDataFrame(list(n.items()), "class_name string, n long")


def test_worklist_and_dark_branches(spark, edges):
    have = counts(spark, car=100, truck=60, cat=30, dog=10)
    rows = {r.node: r for r in ontology.worklist(edges, have).collect()}
    assert {k: (r.action, r.n, r.target) for k, r in rows.items()} == {"frog": ("acquire", 0, 40.0), "dog": ("augment", 10, 40.0), "cat": ("augment", 30, 40.0)}
    assert ontology.leaf_coverage(edges, have).first().leaf_coverage == 0.8
    assert [r.node for r in ontology.dark_branches(edges, have).collect()] == ["amphibian"]
    assert {r.node: r.shortfall for r in ontology.worklist(edges, have, {"dog": 0.25}).collect()}["dog"] == 40


def test_closure_and_lint(spark, edges):
    assert max(r.depth for r in ontology.closure(edges).collect()) == 3
    found = {(r.finding, r.node) for r in ontology.lint(edges, "^[a-z]+$").collect()}
    assert ("root", "subject") in found and ("unary_parent", "amphibian") in found and not [x for x in found if x[0] == "pattern"]
    with pytest.raises(ValueError, match="cycle"):
        ontology.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))
    assert {r.class_name: r.verdict for r in ontology.resolve(spark.createDataFrame([("car",), ("boat",)], "class_name string"), edges).collect()} == {"car": "one", "boat": "none"}


def test_bins_and_levels(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.5,), (9.0,), (None,), (float("nan"),)], "v double")
    bins = encoding.Bins((-math.inf, 0, 1, math.inf))
    assert bins.names() == ["< 0", "[0, 1)", ">= 1"]
    assert [r[0] for r in df.select(bins.code(df.v)).collect()] == [1, 2, 3, 3, 5, 5]
    fit = {r.code: r.n for r in encoding.bin_fit(spark.createDataFrame([(5.0,), (6.0,)], "v double"), "v", bins).collect()}
    assert fit == {1: 0, 2: 0, 3: 2}
    assert len(encoding.uniform_width(df.filter("v is not null and not isnan(v)"), "v", 4).edges) == 5
    levels = encoding.Levels(("a", "b"))
    assert levels.extended(["c", "a"]).levels == ("a", "b", "c")
    assert encoding.comparable(levels, levels.extended(["c"])).levels == ("a", "b", "c")
    assert encoding.comparable(levels, encoding.Levels(("b",))) is None and encoding.comparable(bins, levels) is None


def test_policy():
    one, two = encoding.Policy({"x": encoding.Bins((0, 1))}), encoding.Policy({"x": encoding.Bins((0, 2))})
    assert one.digest() != two.digest() and encoding.shared_digest([one, one]) == one.digest() and encoding.shared_digest([one, two]) is None
    with pytest.raises(ValueError):
        encoding.Policy(strict=True)
    with pytest.raises(ValueError):
        encoding.Policy({"x": encoding.Bins((0, 1), "derived")}, strict=True)


def test_outliers_of_constant_and_null_metrics(spark):
    df = spark.createDataFrame([(i, 1.0, None) for i in range(20)] + [(99, 50.0, 2.0)], "k long, a double, b double")
    for method in ("zscore", "modzscore", "iqr", "adaptive"):
        assert [(r.k, r.metric_name) for r in quality.outlier_issues(df, ["k"], ["a", "b"], method).collect()] == [(99, "a")]
    with pytest.raises(ValueError):
        quality.outlier_issues(df, ["k"], ["a"], "adaptive", 1).count() if quality.distance("nope", df.a) is None else None


def test_longest_run(spark):
    df = spark.createDataFrame(list(enumerate([True, True, False, True, True, True])), "chunk long, drifted boolean")
    assert tuple(quality.longest_run(df, "chunk", "drifted").first()) == (83.3, 3)


def test_chi_squared_tail():
    assert labels.chi2_sf(14.0, 2) == pytest.approx(math.exp(-7)) and labels.chi2_sf(0, 3) == 1 and labels.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


def test_adjusted_information_is_zero_by_chance_and_one_for_copies():
    assert labels.adjusted_mi([("a", "x", 25), ("a", "y", 25), ("b", "x", 25), ("b", "y", 25)]) == pytest.approx(0, abs=0.02)
    assert labels.adjusted_mi([("a", "x", 50), ("b", "y", 50)]) == pytest.approx(1)


def test_knn_in_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    found = {(r.k, r["rank"]): r.neighbor for r in neighbors.knn(df, df, "k", "x", 4, block=20).collect()}
    assert found == {(i, r + 1): int(j) for i in range(150) for r, j in enumerate(np.argsort(d[i], kind="stable")[:4])}


def test_coverage_guards(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "k long, x array<double>")
    assert neighbors.coverage(df, "k", "x")[0] is None
    wide = spark.createDataFrame([(i, np.random.default_rng(i).random(400).tolist()) for i in range(60)], "k long, x array<double>")
    assert neighbors.coverage(wide, "k", "x", "naive", num_observations=10)[1] == "adaptive (naive overflowed)"


def test_class_profile(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, rng.random(8).tolist()) for i in range(60)] + [(100 + i, 1, (rng.random(8) * 0.01).tolist()) for i in range(60)] + [(200 + i, 2, rng.random(8).tolist()) for i in range(5)]
    found = {r.label: r for r in neighbors.class_profile(spark.createDataFrame(rows, "k long, label int, x array<double>"), "k", "label", "x").collect()}
    assert found[1].dispersion < found[0].dispersion and not found[2].assessable and found[2].isotropy is None


def test_drift_statistics_against_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=80), rng.normal(0.8, 1, size=60)
    side = lambda v: spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(v)], "k long, x array<double>")
    long = shift.melted(side(a), side(b), "x")
    z = np.sort(np.concatenate([a, b]))
    f, g = (np.searchsorted(np.sort(v), z, side="right") / len(v) for v in (a, b))
    assert shift.ks(long, ["dim"]).first().statistic == pytest.approx(np.abs(f - g).max())
    u = (b[:, None] > a[None]).sum()
    row = shift.mwu(long, ["dim"]).first()
    assert row.statistic == pytest.approx(u) and row.p_val < 1e-4
    assert shift.cvm(long, ["dim"]).first().statistic == pytest.approx(80 * 60 / 140**2 * ((f - g) ** 2).sum())
    assert all(shift.TESTS[t](long, ["dim"]).first().statistic > 0 for t in ("anderson", "bws"))
    assert shift.corrected(shift.ks(long, ["dim"]), correction="fdr").first().drifted


def test_mmd_and_tree_divergence(spark):
    rng = np.random.default_rng(3)
    same = shift.mmd2(rng.normal(size=(60, 3)), rng.normal(size=(60, 3)), 50)
    apart = shift.mmd2(rng.normal(size=(60, 3)), rng.normal(2, 1, size=(60, 3)), 50)
    assert same[1] > 0.05 > apart[1] and apart[0] > same[0]
    side = lambda m, k: spark.createDataFrame([(k + i, v.tolist()) for i, v in enumerate(rng.normal(m, 1, size=(50, 3)))], "k long, x array<double>")
    assert neighbors.mst_divergence(side(0, 0), side(9, 100), "k", "x") > 0.9 > 0.5 > neighbors.mst_divergence(side(0, 0), side(0, 100), "k", "x")


def prim(x):
    """Edges of a minimum spanning tree by brute force."""
    left, out = set(range(1, len(x))), []
    while left:
        inside = [i for i in range(len(x)) if i not in left]
        d = ((x[inside][:, None] - x[sorted(left)][None]) ** 2).sum(2)
        i, j = np.unravel_index(d.argmin(), d.shape)
        out.append((inside[i], sorted(left)[j]))
        left.remove(out[-1][1])
    return out


@pytest.mark.parametrize("most", [500_000, 60])
def test_spanning_tree_in_many_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(neighbors, "DRIVER_EDGES", most)
    x = np.random.default_rng(4).normal(size=(120, 3))
    x[100:] = x[7]  # copies of one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "k long, x array<double>")
    found = {(r.a, r.b) for r in neighbors.spanning_tree(df, "k", "x", block=20).collect()}
    distinct = {(min(e), max(e)) for e in prim(x[:100])}
    assert found == distinct | {(7, i) for i in range(100, 120)}


def test_tree_divergence_above_the_former_cap(spark):
    side = lambda start: spark.range(start, start + 10_500).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("x"))
    assert neighbors.mst_divergence(side(0), side(10_500), "k", "x") == pytest.approx(1 - 1 * 21_000 / (2 * 10_500**2))


def test_mmd_over_all_rows_in_blocks(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(140, 3)), rng.normal(0.1, 1, size=(91, 3))
    side = lambda z: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)] + [(999, None)], "k long, x array<double>")
    for block in (30, 2048):
        assert shift.drift_mmd(side(x), side(y), "k", "x", 10, block=block).first().mmd2 == pytest.approx(shift.mmd2(x, y)[0], abs=1e-8)


def test_mmd_sees_drift_of_few_rows(spark):
    x, y = (np.random.default_rng(s).normal(size=(2600, 2)) for s in (6, 7))
    y[:100] = 6  # a sample of 500 a side holds about 19 of them
    side = lambda z: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "k long, x array<double>")
    row = shift.drift_mmd(side(x), side(y), "k", "x", 50).first()
    assert row.mmd2 == pytest.approx(shift.mmd2(x, y)[0], abs=1e-8) and row.drifted
    assert not shift.drift_mmd(side(x), side(x[::-1]), "k", "x", 50).first().drifted


def test_chunks(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    size = lambda **o: sorted(r["count"] for r in shift.chunks(df, "k", **o).groupBy("chunk").count().collect())
    assert size(size=10) == [3, 10, 10] and size(size=10, incomplete="drop") == [10, 10] and size(size=10, incomplete="append") == [10, 13] and len(size(count=5)) == 5
    with pytest.raises(ValueError):
        shift.chunks(df, "k", size=1, count=1)


def test_folds_partition_the_rest(spark):
    df = spark.range(1000).selectExpr("id as k", "id % 4 as c")
    rows = splitting.stratified(df, "k", "c", 0.2, folds=3).collect()
    assert len(rows) == 1000 and sum(r.split == "test" for r in rows) == 200 and {r.fold for r in rows if r.split == "train"} == {0, 1, 2}
    once = splitting.stratified(df.repartition(7), "k", "c", 0.2, folds=3).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, once), key=str)


def test_views(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "k long, class_label string")
    run = lambda *ops: [(r.k, r.class_label) for r in views.build_view(df, ops, "k").orderBy("view_pos").collect()]
    assert run({"type": "Limit", "params": {"size": 2}}, {"type": "Reverse"}) == [(1, "b"), (0, "a")]
    assert run({"type": "Indices", "params": {"indices": {"start": 6, "stop": 0, "step": -3}}}) == [(6, "a"), (3, "a")]
    assert run({"type": "Indices", "params": {"indices": [5, 5, 1]}}) == [(5, "c"), (5, "c"), (1, "b")]
    assert len(run({"type": "ClassFilter", "params": {"classes": ["a", "b"]}}, {"type": "ClassBalance", "params": {"method": "global"}})) == 6
    assert {c for _, c in run({"type": "Relabel", "params": {"map": {"a": "z"}}})} == {"z", "b", "c"}
    assert sorted(run({"type": "Shuffle", "params": {"seed": 4}})) == sorted(run({"type": "Reverse"}))
    with pytest.raises(ValueError, match="unknown view"):
        run({"type": "Nope"})
    items = views.positioned(spark.createDataFrame([(0,), (1,)], "item_index long"), "item_index")
    boxes = spark.createDataFrame([(0, 0, 2.0, 2.0, 20.0, 20.0), (0, 1, 5.0, 5.0, 5.0, 9.0), (1, 0, 0.0, 0.0, 1.0, 1.0)], "item_index long, target_index long, x0 double, y0 double, x1 double, y1 double")
    crops, dropped = views.detection_crops(items, boxes)
    assert crops.count() == 2 and dropped.first()[0] == 1


def test_level_propagation(spark):
    unit = spark.createDataFrame([(i, "sun" if i % 2 else "rain", 1.0) for i in range(6)], "item_index long, weather string, mean double")
    boxes = spark.createDataFrame([(i, t, 2.0) for i in range(6) for t in (0, 1)], "item_index long, target_index long, mean double")
    rows = encoding.propagate(unit, boxes, "item_index", ["weather", "mean"]).collect()
    assert len(rows) == 12 and all(r.weather and r.unit_mean == 1 and r.instance_mean == 2 for r in rows)


def test_spanning_tree_of_groups_that_lists_do_not_leave(spark):
    """Groups of more rows than a list has neighbours, far apart; their edges come from searches outside the component."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(100 * g, 1, size=(30, 3)) for g in range(5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>")
    found = {(r.a, r.b) for r in neighbors.spanning_tree(df, "k", "x", block=25).collect()}
    assert found == {(min(e), max(e)) for e in prim(x)}


def test_blocks_that_meet_move_with_the_parts_not_with_the_blocks(spark):
    n = 200
    blocks = spark.range(n).select(F.col("id").cast("int").alias("b"))
    cells = neighbors.meetings(blocks, n)
    assert cells.count() == n * (neighbors.WAYS + 1)  # before: n / 2 times each
    kinds = pa.schema({"i": pa.int32(), "j": pa.int32()})
    met = cells.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist([{"i": i[0], "j": j[0]} for i, j in neighbors.met_pairs(batches, tuple)], kinds),), "i int, j int")
    pairs = [tuple(sorted(r)) for r in met.collect()]
    assert len(pairs) == len(set(pairs)) == n * (n + 1) // 2


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e20])
def test_neighbours_far_from_the_origin_and_of_any_size(spark, scale):
    """Single precision can't tell these apart: the bound sends them to double precision."""
    rng = np.random.default_rng(9)
    x = (np.array([1e4, -1e4, 0.0]) + rng.normal(size=(90, 3))) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    found = {(r.k, r.rank): r.neighbor for r in neighbors.knn(df, df, "k", "x", 3, block=30).collect()}
    assert found == {(i, m + 1): j for i, row in enumerate(np.argsort(d, 1)[:, :3].tolist()) for m, j in enumerate(row)}
