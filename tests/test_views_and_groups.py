import numpy as np
import pytest

from plumbline.operators import neighbors
from plumbline.plans import config as c
from plumbline.plans.views import build_view, detection_crops
from plumbline.plans.workflows import WORKFLOWS, Result, run_tasks
from plumbline.sources.datasets import SourceFrames

IMAGE = "struct<height:int,width:int,nChannels:int,data:binary>"


def boxed(spark):
    x = np.arange(3 * 6 * 8 * 3, dtype=np.uint8).reshape(3, 6, 8, 3)
    items = spark.createDataFrame([(i, "sun", (6, 8, 3, bytearray(p.tobytes()))) for i, p in enumerate(x)] + [(3, "rain", None)], f"item_index long, weather string, image {IMAGE}")
    boxes = [(0, 0, 1.0, 2.0, 4.0, 5.0, 1), (0, 1, 3.0, 3.0, 3.0, 9.0, 0), (2, 1, 6.0, 4.0, 20.0, 20.0, 0), (2, 0, 0.0, 0.0, 8.0, 6.0, 1), (3, 0, 0.0, 0.0, 2.0, 2.0, 1), (9, 0, 0.0, 0.0, 2.0, 2.0, 1)]
    return x[..., [2, 1, 0]], items, spark.createDataFrame(boxes, "item_index long, target_index long, x0 double, y0 double, x1 double, y1 double, class_label int")


def test_crops_are_items_in_order_with_their_pixels(spark):
    x, items, boxes = boxed(spark)
    view = build_view(items, [{"type": "Reverse"}, {"type": "DetectionCrops"}, {"type": "Limit", "params": {"size": 3}}], "item_index", targets=boxes)
    rows = view.orderBy("item_index").collect()
    assert [(r.item_index, r.source_item, r.target_index, r.class_label, r.weather) for r in rows] == [(0, 3, 0, 1, "rain"), (1, 2, 0, 1, "sun"), (2, 2, 1, 0, "sun")]
    assert rows[0].image.data is None and [(r.image.height, r.image.width) for r in rows[1:]] == [(6, 8), (2, 2)]
    assert np.array_equal(np.frombuffer(rows[2].image.data, np.uint8).reshape(2, 2, 3), x[2, 4:6, 6:8])
    positions = build_view(items, [], "item_index")
    assert detection_crops(positions, boxes)[1].first().dropped == 1  # without area; that of an item that isn't there doesn't count
    with pytest.raises(ValueError, match="targets"):
        build_view(items, [{"type": "DetectionCrops"}], "item_index")


def test_crops_in_a_configuration(spark):
    _, items, boxes = boxed(spark)
    raw = {
        "datasets": [{"name": "d", "path": "x"}], "views": [{"name": "v", "operations": [{"type": "DetectionCrops"}, {"type": "Resize", "params": {"size": [4, 4]}}]}], "sources": [{"name": "s", "dataset": "d", "view": "v"}],
        "extractors": [{"name": "flat", "model": "flatten"}], "workflows": [{"name": "w", "type": "data-splitting", "test_frac": 0.25}], "tasks": [{"name": "t", "workflow": "w", "sources": "s", "extractor": "flat"}],
    }
    (result,) = run_tasks(spark, c.Pipeline.model_validate(raw), frames={"d": SourceFrames(items, boxes)})
    assert result.success, result.errors
    assert {r.item_index for r in result.tables["splits"].collect()} == {0, 1, 2, 3}


def test_outlier_groups_choose_metrics(spark):
    items = spark.createDataFrame([(i, 10.0 + i % 3, 5.0, 7.0 + i % 2) for i in range(40)] + [(40, 500.0, 5.0, 7.0), (41, 11.0, 5.0, 900.0)], "item_index long, mean double, brightness double, width double")
    out = Result("data-cleaning", ["a"])
    p = c.Cleaning(name="x", type="data-cleaning", outlier_method="zscore", outlier_flags=["pixel", "visual"])
    assert p.chosen(items.columns) == ["mean", "brightness"] and p.model_copy(update={"metrics": ["width", "mean"]}).chosen(items.columns) == ["width", "mean", "brightness"]
    WORKFLOWS["data-cleaning"]({"a": SourceFrames(items)}, p, out)
    assert {(r.item_index, r.metric_name) for r in out.tables["outliers"].collect()} == {(40, "mean")}
    with pytest.raises(ValueError, match="outlier_flags"):
        c.Sweep(name="x", type="parameter-sweep")
    with pytest.raises(ValueError, match="image_stats"):
        p.chosen(["item_index"])


def test_gram_matrices_give_each_class_s_isotropy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 6, 400)
    x = rng.normal(size=(400, 4)) * (1 + labels[:, None] * [0, 0.3, 0.7, 1])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "k long, x array<double>, label int").repartition(3)

    def ratio(y):
        values = np.linalg.eigvalsh(np.cov(y.T, bias=True))
        return values.sum() ** 2 / (values**2).sum()

    wanted = np.array([ratio(x[labels == c]) for c in range(6)])
    for most in (64, 2):
        monkeypatch.setattr(neighbors, "GRAM_CLASSES", most)
        found = {r.label: r.isotropy for r in neighbors.class_profile(df, "k", "label", "x").collect()}
        assert [found[c] for c in range(6)] == pytest.approx(wanted / np.median(wanted))


def test_cache_key_of_a_policy():
    p = c.MetadataPolicy(name="a", continuous_factor_bins={"lux": 3})
    same = [p.model_copy(update=u) for u in ({"name": "b"}, {"factor_source": "values"}, {"reference_split": "s"})]
    other = [p.model_copy(update=u) for u in ({"strict": True}, {"exclude": ["x"]}, {"continuous_factor_bins": {"lux": 4}}, {"auto_bin_method": "clusters"})]
    assert {q.cache_key() for q in same} == {p.cache_key()} and len({q.cache_key() for q in [p, *other]}) == 5
