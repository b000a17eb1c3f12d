import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import boosting, shift
from plumbline.plans import config as c
from plumbline.plans.workflows import WORKFLOWS, Result, SourceFrames

SCHEMA = "item_index long, embedding array<double>, class_label int"


def frame(spark, x, labels=None, start=0):
    return spark.createDataFrame([(start + i, v.tolist(), int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)], SCHEMA)


def run(p, **sources):
    out = Result("drift-monitoring", list(sources))
    WORKFLOWS["drift-monitoring"]({k: SourceFrames(v) for k, v in sources.items()}, p, out)
    return out, {f.title: f for f in out.findings}


def drift(*detectors):
    return c.Drift(name="x", type="drift-monitoring", detectors=list(detectors))


@pytest.mark.parametrize("test", ["ks", "cvm", "mwu", "anderson", "bws"])
def test_univariate_values_are_those_of_a_loop(spark, test):
    """Also with ties, and a last chunk that is incomplete."""
    rng = np.random.default_rng(5)
    reference, rows = np.round(rng.normal(0, 1, (70, 2)), 1), np.round(rng.normal(0.4, 1.3, (50, 2)), 1)
    a, b = frame(spark, reference), frame(spark, rows)
    for incomplete, ends in (("keep", (20, 40, 50)), ("drop", (20, 40)), ("append", (20, 50)))[: 3 if test == "ks" else 1]:
        placed = shift.in_chunks(a, b, "embedding", "item_index", size=20, incomplete=incomplete)
        found = {r.chunk: r.value for r in shift.univariate_chunks(a, placed, "embedding", test).collect()}
        spans = {r.chunk: (r.start_index, r.end_index) for r in shift.chunk_spans(placed).collect()}
        assert [spans[i] for i in range(len(ends))] == list(zip((0, *ends), ends)) and len(found) == len(ends) + len({"keep": (20, 40, 60, 70), "drop": (20, 40, 60), "append": (20, 40, 70)}[incomplete])
        if incomplete != "keep":
            continue
        for chunk in (-4, 2):
            lo, hi = spans[chunk]
            part = (b if chunk >= 0 else a).filter(f"item_index >= {lo} and item_index < {hi}")
            loop = shift.TESTS[test](shift.melted(a, part, "embedding"), ["dim"])
            wanted = loop.agg(F.avg(F.abs("z") if test == "mwu" else "statistic")).first()[0]
            assert found[chunk] == pytest.approx(wanted)


def test_other_values_are_those_of_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(6)
    reference, rows = rng.normal(0, 1, (60, 3)), rng.normal(0.5, 1, (45, 3))
    a, b = frame(spark, reference), frame(spark, rows)
    placed = shift.in_chunks(a, b, "embedding", "item_index", size=20, incomplete="drop").checkpoint()
    every = np.concatenate([reference, rows[:40]])
    d = ((every[:, None] - every[None]) ** 2).sum(-1)
    sigma2 = np.median(d[np.triu_indices(len(every), 1)])
    k = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(-1) / (2 * sigma2))
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    parts = {-1: reference[:20], -2: reference[20:40], -3: reference[40:], 0: rows[:20], 1: rows[20:40]}
    wanted = {c: off(k(reference, reference)) + off(k(x, x)) - 2 * k(x, reference).mean() for c, x in parts.items()}
    for block in (2048, 17):
        found = {r.chunk: r.value for r in shift.mmd_chunks(a, placed, "embedding", block).collect()}
        assert found == pytest.approx(wanted, abs=1e-6)
    dist = np.sqrt(((every[:, None] - reference[None]) ** 2).sum(-1))
    dist[np.arange(60), np.arange(60)] = np.inf
    near = np.sort(dist, axis=1)[:, :10].mean(1)
    found = {r.chunk: r.value for r in shift.knn_chunks(a, placed, "item_index", "embedding").collect()}
    assert found == pytest.approx({-1: near[:20].mean(), -2: near[20:40].mean(), -3: near[40:60].mean(), 0: near[60:80].mean(), 1: near[80:].mean()})
    scored = spark.createDataFrame([(i, 0, float(p)) for i, p in enumerate(np.round(rng.random(60), 1))] + [(i, 1, float(p)) for i, p in enumerate(np.round(rng.random(45), 1))], "item_index long, label int, probability double")
    p = {(r.label, r.item_index): r.probability for r in scored.collect()}
    known = np.array([p[0, i] for i in range(60)])
    auc = lambda x: ((x[:, None] > known[None]) + (x[:, None] == known[None]) / 2).mean()
    found = {r.chunk: r.value for r in shift.classifier_chunks(scored, placed, "item_index").collect()}
    assert found == pytest.approx({-1: auc(known[:20]), -2: auc(known[20:40]), -3: auc(known[40:]), 0: auc(np.array([p[1, i] for i in range(20)])), 1: auc(np.array([p[1, i] for i in range(20, 40)]))})


def test_each_detector_sees_in_chunks_what_it_looks_for(spark):
    """A correlation that comes up drifts for mmd in every chunk, a variance for ks; means stay."""
    rng = np.random.default_rng(7)
    normal = lambda n: rng.normal(0, 1, (n, 2))
    tied = rng.normal(0, 1, (320, 1)) * [1, 1] + rng.normal(0, 0.15, (320, 2))
    out, found = run(drift({"method": "mmd", "n_permutations": 20, "chunking": {"chunk_size": 80}}), a=frame(spark, normal(640)), b=frame(spark, tied))
    assert not out.errors and found["Chunked Drift: mmd"].data == {"percent_drifted": 100.0, "longest_run": 4}
    rows = sorted(out.tables["mmd.chunks"].collect(), key=lambda r: r.chunk)
    assert [(r.key, r.start_index, r.end_index) for r in rows] == [(f"[{i}:{i + 80}]", i, i + 80) for i in (0, 80, 160, 240)]
    wide = normal(300) * 4
    out, found = run(drift({"chunking": {"chunk_size": 80, "incomplete": "append"}}, {"method": "domain_classifier", "n_folds": 3}), a=frame(spark, normal(640)), b=frame(spark, wide))
    assert not out.errors and found["Chunked Drift: univariate"].data == {"percent_drifted": 100.0, "longest_run": 3}
    assert found["Drift: domain_classifier"].data["drifted"] and found["Drift: domain_classifier"].data["auroc"] > 0.8


def test_corrections_by_class_alternatives_and_features(spark):
    rng = np.random.default_rng(8)
    labels = np.arange(120) % 2
    reference, rows = rng.normal(0, 1, (120, 6)), rng.normal(0, 1, (120, 6))
    rows[labels == 1, :5] += 0.62  # each too little for a sixth of the level, but most below it
    a, b = frame(spark, reference, labels), frame(spark, rows, labels)
    out, found = run(drift({"classwise": True, "correction": "fdr"}, {"classwise": True, "correction": "bonferroni"}), a=a, b=b)
    tables = [{(r.class_label, r.dim): r for r in out.tables[f"univariate_{i}.classwise"].collect()} for i in (1, 2)]
    for label in (0, 1):
        p = sorted(tables[0][label, i].p_val for i in range(6))
        most = max((i + 1 for i in range(6) if p[i] <= 0.05 * (i + 1) / 6), default=0)
        assert sum(tables[0][label, i].drifted for i in range(6)) == most
        assert all(tables[1][label, i].drifted == (tables[1][label, i].p_val < 0.05 / 6) for i in range(6))
    assert sum(r.drifted for r in tables[0].values()) > sum(r.drifted for r in tables[1].values()) > 0
    up = frame(spark, reference + 1.0)
    for test, seen in (("ks", [False, True]), ("mwu", [True, False])):  # smaller values: a distribution function above
        _, found = run(drift({"test": test, "alternative": "less"}, {"test": test, "alternative": "greater"}), a=a, b=up)
        assert [found[f"Drift: univariate_{i}"].data["drifted"] for i in (1, 2)] == seen
    out, _ = run(drift({"test": "cvm", "alternative": "less"}, {"alternative": "up"}, {"n_features": 5}), a=a, b=up)
    assert [e.split(": ", 1)[1] for e in out.errors] == ["cvm has no one-sided form; ks, mwu have", "unknown alternative 'up'; one of two-sided, less, greater", "expected 5 features, found 6"]


def test_one_sided_p_values(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(0, 1, 50), rng.normal(0.3, 1, 40)
    long = spark.createDataFrame([(float(v), 0) for v in x] + [(float(v), 1) for v in y], "v double, is_test int")
    points = np.concatenate([x, y])
    gap = (x[:, None] <= points).mean(0) - (y[:, None] <= points).mean(0)
    for alternative, d in (("greater", gap.max()), ("less", (-gap).max())):
        row = shift.ks(long, [], alternative).first()
        assert row.statistic == pytest.approx(max(d, 0)) and row.p_val == pytest.approx(np.exp(-2 * max(d, 0) ** 2 * 50 * 40 / 90))
    both, less, greater = (shift.mwu(long, [], k).first().p_val for k in ("two-sided", "less", "greater"))
    assert less == pytest.approx(both / 2) and greater == pytest.approx(1 - both / 2)


def test_trees_learn_what_lines_can_t(spark):
    """Equal means, unlike variances; and two features that tell only together."""
    rng = np.random.default_rng(10)
    a, b = rng.normal(0, 1, (400, 4)), rng.normal(0, 4, (300, 4))
    found, drifted, scored = shift.domain_classifier(frame(spark, a), frame(spark, b, start=400), "item_index", "embedding")
    assert found > 0.9 and drifted and scored.count() == 700
    x = rng.uniform(-1, 1, (800, 3))
    side = (x[:, 0] * x[:, 1] > 0).astype(int)
    data = spark.createDataFrame([(i, v.tolist(), int(s)) for i, (v, s) in enumerate(zip(x, side))], "k long, x array<double>, y int")
    assert boosting.auroc(boosting.out_of_fold(data, "k", "x", "y"), "y", "probability") > 0.85
    noise = data.withColumn("y", (F.xxhash64("k") % 2 == 0).cast("int"))
    assert 0.35 < boosting.auroc(boosting.out_of_fold(noise, "k", "x", "y"), "y", "probability") < 0.65
    assert boosting.out_of_fold(data.limit(0), "k", "x", "y").count() == 0


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    """Rows that only their own label tells apart: each has a feature value of its own and is scored as by chance."""
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 300)
    data = spark.createDataFrame([(i, [float(i)], int(v)) for i, v in enumerate(y)], "k long, x array<double>, y int")
    fine = boosting.auroc(boosting.out_of_fold(data, "k", "x", "y", folds=3), "y", "probability")
    assert fine < 0.65
    again = {r.k: r.probability for r in boosting.out_of_fold(data.repartition(7), "k", "x", "y", folds=3).collect()}
    assert again == pytest.approx({r.k: r.probability for r in boosting.out_of_fold(data, "k", "x", "y", folds=3).collect()})


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(12)
    sums = np.abs(rng.normal(size=(3, 4, boosting.BINS, 2)))
    sums[..., 0] -= 0.5
    sums[:, 1:] *= (sums[:, :1].sum(2, keepdims=True) / sums.sum(2, keepdims=True)[:, 1:])  # all features see the same rows
    feature, code, sides = boosting.best_splits(sums)
    value = lambda s: s[0] ** 2 / (s[1] + boosting.PRIOR)
    for node in range(3):
        gains = {(f, k): value(sums[node, f, : k + 1].sum(0)) + value(sums[node, f, k + 1 :].sum(0)) for f in range(4) for k in range(boosting.BINS - 1)}
        assert gains[feature[node], code[node]] == pytest.approx(max(gains.values()))
        assert np.allclose(sides[node, 0], sums[node, feature[node], : code[node] + 1].sum(0))
