"""Quality by compression: a text that a dictionary of good texts helps more than one of bad texts is likelier good.

One zstandard dictionary is built from passages of good texts and one from passages of bad ones. A text is cut into
passages of ``PASSAGE`` bytes, each is compressed with either dictionary on its own, and the difference of the summed sizes
(bad minus good), divided by the text's bytes, is its evidence. A logistic curve in evidence and size, fitted on labelled
texts that the dictionaries were not built from and weighted to the labels' shares in all labelled rows, makes it a
probability.

Learning reads a bounded sample: ``per_label`` texts of each label, those with the smallest hash of their key, of which
three quarters give passages to the dictionaries (up to ``PASSAGES`` of a text, evenly spread over it) and one quarter, read
whole, the curve. How common the labels are is counted over all rows. Scoring reads every text whole, in one pure map.

Defined results: null texts count as empty ones, whose evidence is 0; a key whose labels disagree, and a label other than
0 and 1, teach nothing; of rows with one key all are scored alike from their own text; with only one label, or none, every
score is its smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import discard, settled, slices

LEVEL = 3
#: Bytes of a passage, passages that a text gives to a dictionary, bytes of a dictionary.
PASSAGE, PASSAGES, DICTIONARY = 500, 8, 1 << 16
SEED = 31
#: Parts that a label's keys are dealt into before the sample is drawn.
SAMPLE_PARTS = 256
#: Weight of the prior that keeps the curve's slopes finite on labels that it parts without error.
RIDGE = 1e-3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries of ``DICTIONARY`` bytes at most (empty: none) and the curve over ``features``."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def passages(raw: bytes, most: int | None = None) -> list[bytes]:
    """The passages of a text, or ``most`` of them evenly spread."""
    starts = range(0, len(raw), PASSAGE)
    if most is not None and len(starts) > most:
        starts = [starts[i * len(starts) // most] for i in range(most)]
    return [raw[i : i + PASSAGE] for i in starts]


def dictionary(found: list[bytes]) -> bytes:
    """Trained on passages, or, where these are too few for training, made of them as they are."""
    found = sorted(found)
    try:
        return zstandard.train_dictionary(DICTIONARY, found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[-DICTIONARY:]


def compressor(made: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(made) < 8:  # the library refuses shorter ones
        return zstandard.ZstdCompressor(**options)
    known = zstandard.ZstdCompressionDict(made)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, **options)


class Scales:
    """Compressed sizes of texts under both dictionaries of a model."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = compressor(good).compress, compressor(bad).compress

    def weigh(self, text: str | None) -> tuple[int, int, int]:
        """Bytes of the text, and what is left of them with the good and the bad dictionary."""
        raw = (text or "").encode()
        good = bad = 0
        for p in passages(raw):
            good += len(self.good(p))
            bad += len(self.bad(p))
        return len(raw), good, bad


def features(sizes: np.ndarray) -> np.ndarray:
    """Of rows (bytes, good, bad): 1, evidence, size (a logarithm), and their product: short texts have noisy evidence."""
    n, good, bad = np.asarray(sizes, np.float64).reshape(-1, 3).T
    evidence, size = (bad - good) / np.maximum(n, 1), np.log2(n + 1) / 16
    return np.stack([np.ones(len(n)), 10 * evidence, size, 10 * evidence * size], 1)


def probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def curve(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of the logistic curve by Newton's method, a row counting ``share``."""
    w = np.zeros(x.shape[1])
    prior = RIDGE * share.sum() * np.diag([0.0, *[1.0] * (len(w) - 1)])
    for _ in range(rounds):
        p = probability(w, x)
        slope = x.T @ (share * (p - y)) + prior @ w
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + prior + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def drawn(rows: DataFrame, per_label: int) -> DataFrame:
    """``k, l`` of the sample: ``per_label`` keys of each label, in levels, so that no task ranks all keys of a label."""
    keys = rows.select("k", "l", F.xxhash64(F.lit(SEED), "k").alias("h"))
    for by in (["l", F.pmod("h", F.lit(SAMPLE_PARTS))], ["l", F.pmod("h", F.lit(SAMPLE_PARTS // 32))], ["l"]):
        keys = keys.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "k"))).filter(F.col("n") <= per_label).drop("n")
    return keys.select("k", "l")


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 4000) -> QualityModel:
    """Learns from the rows of ``df`` whose key ``labels`` marks. ``per_label`` bounds the texts of a label that are read."""
    marks = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("l")).filter("k is not null and l in (0, 1)")
    marks = marks.groupBy("k").agg(F.min("l").alias("l"), F.max("l").alias("m")).filter("l = m").select("k", "l")
    rows = df.select(df[key].alias("k"), df[text].alias("t")).filter("k is not null and t is not null")
    keys = settled(rows.select("k").distinct().join(marks, "k"))
    counted = {r.l: r["count"] for r in keys.groupBy("l").count().collect()}
    if len(counted) < 2:
        n, good = sum(counted.values()), counted.get(1, 0)
        return QualityModel(b"", b"", (float(np.log((good + 0.5) / (n - good + 0.5))), 0.0, 0.0, 0.0))
    # at most twice per_label keys; of rows with one key, the one whose text has the least hash
    found = rows.join(F.broadcast(drawn(keys, per_label)), "k")
    order = Window.partitionBy("k").orderBy(F.xxhash64("t"), "t")
    found = found.withColumn("n", F.row_number().over(order)).filter("n = 1")
    sample = settled(found.select("k", "t", "l", (F.pmod(F.xxhash64(F.lit(SEED + 1), "k"), F.lit(4)) == 0).alias("apart")))
    discard(keys)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [(label, p) for label, t in zip(*(c.to_pylist() for c in part.columns)) for p in passages(t.encode(), PASSAGES)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.binary()))], ["l", "p"])

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"l": part["l"].iloc[:1], "made": [dictionary(part["p"].tolist())]})

    # a label's passages are 4 kB a text at most: they meet in one task, the texts don't
    cuts = sample.filter("not apart").select("l", "t").mapInArrow(cut, "l int, p binary")
    made = {r.l: bytes(r.made) for r in cuts.groupBy("l").applyInPandas(build, "l int, made binary").collect()}
    good, bad = made.get(1, b""), made.get(0, b"")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scales = Scales(good, bad)
        for part in slices(batches):
            sizes = [scales.weigh(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.list_(pa.int64()))], ["l", "sizes"])

    weighed = sample.filter("apart").select("l", "t").mapInArrow(weigh, "l int, sizes array<bigint>").collect()
    discard(sample)
    y = np.array([r.l for r in weighed], np.float64)
    held = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    share = np.array([counted[int(v)] / held[int(v)] for v in y])
    if not len(y):  # a handful of labels
        y, share, weighed = np.array([0.0, 1.0]), np.array([float(counted[0]), float(counted[1])]), [(0, [0, 0, 0]), (1, [0, 0, 0])]
    weights = curve(features(np.array([r[1] for r in weighed])), y, share)
    return QualityModel(good, bad, tuple(map(float, weights)))


def score(df: DataFrame, model: QualityModel, text: str = "text", bar: float = 0.7) -> DataFrame:
    """The rows with ``score, predicted`` (1 from ``bar`` on; replaced if they are there): a pure map."""
    outputs = ("score", "predicted")
    rest = [c for c in df.columns if c not in outputs or c == text]
    kept = df.select(*(df[c].alias(f"c{i}") for i, c in enumerate(rest)))
    at = rest.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scales, weights = Scales(model.good, model.bad), np.array(model.weights)
        for part in slices(batches, at):
            found = probability(weights, features(np.array([scales.weigh(t) for t in part.column(at).to_pylist()])))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= bar).astype(np.int32))], [*part.schema.names, "s", "p"])

    schema = ", ".join([*(f"c{i} {kind}" for i, (_, kind) in enumerate(kept.dtypes)), "s double, p int"])
    return kept.mapInArrow(run, schema).toDF(*rest, *outputs)
