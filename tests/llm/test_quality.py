import random
import zlib

import numpy as np
import pytest
import zstandard

from plumbline.llm import queries
from plumbline.llm.quality import PASSAGE, Scales, curve, dictionary, features, fit, passages, probability, score

SF = "/root/testdata/sf0.01"


def by_hand(model, text):
    """The definition: sizes of passages compressed one by one, the difference over the bytes, the curve."""
    raw = (text or "").encode()
    left = {}
    for name in ("good", "bad"):
        known = zstandard.ZstdCompressionDict(getattr(model, name)) if len(getattr(model, name)) >= 8 else None
        one = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        left[name] = sum(len(one.compress(raw[i : i + 500])) for i in range(0, len(raw), 500))
    evidence, size = (left["bad"] - left["good"]) / max(len(raw), 1), np.log2(len(raw) + 1) / 16
    a, b, c, d = model.weights
    return 1 / (1 + np.exp(-(a + 10 * b * evidence + c * size + 10 * d * evidence * size)))


def auc(scores, good):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = good.sum()
    return (rank[good == 1].sum() - n * (n + 1) / 2) / (n * (len(good) - n))


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return fit(docs.filter(~queries.langid.held_out("doc_id", 4, 2)), labels, "doc_id", "text", "quality")


def test_query_tells_good_from_bad_where_it_has_not_learnt(spark):
    rows = queries.QUERIES["op13_quality"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    scores, good, predicted = map(np.array, zip(*unseen))
    assert len(good) > 80 and auc(scores, good) > 0.95
    assert (predicted == good).mean() > 0.9
    assert abs(scores.mean() - good.mean()) < 0.06  # calibrated


def test_scores_follow_the_definition(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    found = score(docs.select("doc_id", "text"), model).collect()
    assert len(found) == 150
    for r in found:
        assert abs(r.score - by_hand(model, r.text)) < 1e-9


def test_reruns_agree_and_labels_of_others_do_not_matter(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = queries.langid.held_out("doc_id", 4, 2)
    turned = labels.withColumn("quality", queries.F.when(out, 1 - labels["quality"]).otherwise(labels["quality"])).repartition(7)
    again = fit(docs.filter(~out).repartition(5), turned, "doc_id", "text", "quality")
    assert again.good == model.good and again.bad == model.bad and np.allclose(again.weights, model.weights)


def test_odd_rows(spark, model):
    df = spark.createDataFrame([(None, "a b", 1.0), (1, None, 2.0), (2, "", 2.0), (3, "é" * 400_000, 3.0), (3, "é" * 400_000, 3.0)], "doc_id long, text string, score double")
    rows = score(df, model).collect()
    assert len(rows) == 5 and rows[0].__fields__ == ["doc_id", "text", "score", "predicted"]
    assert all(abs(r.score - by_hand(model, r.text)) < 1e-9 for r in rows)
    assert {r.doc_id: r.score for r in rows}[1] == {r.doc_id: r.score for r in rows}[2]
    assert score(df.limit(0), model).count() == 0


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)] + [(9, None), (None, "x")], "doc_id long, text string")
    schema = "doc_id long, quality int"
    assert {r.score for r in score(docs, fit(docs, spark.createDataFrame([], schema), "doc_id")).collect()} == {0.5}
    one = fit(docs, spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 5), (5, 0), (5, 1), (77, 0)], schema), "doc_id")
    assert {round(r.score, 6) for r in score(docs, one).collect()} == {round(2.5 / 3, 6)}
    both = fit(docs, spark.createDataFrame([(1, 1), (2, 0), (9, 0)], schema), "doc_id")
    assert all(0 <= r.score <= 1 for r in score(docs, both).collect())


def test_dictionaries_and_curve():
    random.seed(1)
    found = ["".join(random.choice("abc de") for _ in range(500)).encode() for _ in range(400)]
    assert zstandard.ZstdCompressionDict(dictionary(found)).dict_id() != 0 and dictionary([b"short"]) == b"short" and dictionary([]) == b""
    raw = bytes(range(250)) * 40
    assert b"".join(passages(raw)) == raw and len(passages(raw, 8)) == 8 and max(map(len, passages(raw))) == PASSAGE
    assert Scales(b"", b"").weigh("") == (0, 0, 0) and Scales(b"", b"").weigh("a" * 900)[0] == 900
    x = features(np.array([[100, 50, 60], [100, 60, 50], [1000, 500, 560], [1000, 560, 500]]))
    w = curve(np.tile(x, (20, 1)), np.tile([1.0, 0, 1, 0], 20), np.ones(80))
    assert (probability(w, x) > 0.5).tolist() == [True, False, True, False]
