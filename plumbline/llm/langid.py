"""Language ID by nearest centroids.

A text becomes a normalised TF-IDF vector of hashed letter n-grams; each language has several centroids, clustered from
its training texts; the language of the nearest centroid by cosine wins. A text too far from every centroid is rejected:
each language has a bar for every size of text, from the low tail of what its own training texts and excerpts of them
reach against centroids that they had no part in.

Learning reads a bounded sample: ``per_label`` texts of every language, those with the smallest hash of their key
(keys are drawn in three levels, only the sample's texts move). Everything else covers all rows.

Defined results: null texts and texts without a letter get ``und``, score 0 and are rejected; ties go to the language
that sorts first; with nothing to learn from, every text is ``und``. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import arrow_map, settled, slices

UNKNOWN = "und"
#: Columns of the hashed vectors.
WIDTH = 1 << 13
#: ASCII that is no letter becomes a space before n-grams are taken.
BLANK = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
#: No bar is below this share of the language's usual (median) training cosine.
REJECT_SHARE = 0.05
#: A bar is this share of this quantile of the cosines of training texts of a size.
TAIL_SHARE, TAIL = 0.4, 0.05
#: Characters of the excerpts that make up for the short texts a sample lacks.
EXCERPTS = (12, 24, 48, 96, 192, 384, 768)
#: Sizes: powers of two of distinct n-grams.
SIZES = 14
SEED = 23
#: Texts classified at once: short ones are many in a slice, and each has a vector of WIDTH.
TEXTS = 256
#: Parts that a language's keys are dealt into before the sample is drawn.
SAMPLE_PARTS = 256


@dataclass(frozen=True)
class LanguageModel:
    """Bounded by languages x centroids x WIDTH floats (32 kB a centroid)."""

    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # one row each, normalised
    owner: np.ndarray  # the language of each
    reject_below: np.ndarray  # by language and size


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams (2 and 3) of the lower-cased letters; each run of other ASCII is a space."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(BLANK).split()) + b" ", np.uint8).astype(np.uint32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    keys = np.concatenate([two | np.uint32(1 << 24), three])
    return np.bincount(((keys * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64), minlength=WIDTH)


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(text)) * idf
    norm = np.sqrt(x @ x)
    return (x / norm if norm else x).astype(np.float32)


def shared_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Without those that fewer than a hundredth of the texts are nearest to: an odd text is no language."""
    centres = spherical_kmeans(x, k)
    members = np.bincount((x @ centres.T).argmax(1), minlength=len(centres))
    return centres[(members * 100 >= len(x)) | (members == members.max())]


def sizes(x: np.ndarray) -> np.ndarray:
    """Of vectors, the power of two of their distinct n-grams: a text that repeats itself is as small as its parts."""
    return np.minimum(np.log2(np.maximum(np.count_nonzero(x, axis=1), 1)).astype(np.int64), SIZES - 1)


def bars(texts: list[str], x: np.ndarray, centroids: int, idf: np.ndarray, floor: float) -> np.ndarray:
    """By size, the cosine below which a text is not of the language of ``texts`` (in order; x: their vectors). Halves are
    measured against the centroids of the other half. A size not met has the bar of the next smaller one."""
    cosines, at = [], []
    for half in (0, 1) if len(x) > 1 else (0,):
        centres = shared_centroids(x[1 - half :: 2] if len(x) > 1 else x, centroids)
        for i in range(half, len(x), 2):
            y = np.stack([x[i], *(vector(texts[i][:n], idf) for n in EXCERPTS if n < len(texts[i]))])
            y = y[y.any(1)]
            cosines.append((y @ centres.T).max(1))
            at.append(sizes(y))
    cosines, at = np.concatenate(cosines), np.concatenate(at)
    out, bar = np.zeros(SIZES), floor
    for k in range(SIZES):
        if (at == k).any():
            bar = max(floor, TAIL_SHARE * float(np.quantile(cosines[at == k], TAIL)))
        out[k] = bar
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to k normalised centroids; starts from the vectors farthest from those chosen before, so reruns agree."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)) and near.min() < 0.999:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[own == j].sum(0) for j in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres).astype(np.float32)
    return centres


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 600, centroids: int = 4) -> LanguageModel:
    """Learns from rows with a label and a letter. ``per_label``: how many texts of each language are read; this bounds
    what the workers and the driver hold, however large the table."""
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")).filter("l is not null and t is not null").filter(F.col("t").rlike(r"\p{L}"))
    # keys first, without texts, and in levels: the best of each part of a language's keys, of some parts, then of these
    keys = rows.select("l", "k", F.xxhash64(F.lit(SEED), "k").alias("h")).distinct()
    for by in (["l", F.pmod("h", F.lit(SAMPLE_PARTS))], ["l", F.pmod("h", F.lit(SAMPLE_PARTS // 32))], ["l"]):
        keys = keys.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "k"))).filter(F.col("n") <= per_label).drop("n")
    chosen = keys.select(F.col("l").alias("kl"), F.col("k").alias("kk"))
    order = Window.partitionBy("l").orderBy(F.xxhash64(F.lit(SEED), "k"), "k", F.xxhash64("t"))
    found = rows.join(F.broadcast(chosen), F.col("l").eqNullSafe(F.col("kl")) & F.col("k").eqNullSafe(F.col("kk")))
    sample = settled(found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_label).select("l", "t"))

    def presence(part: pd.DataFrame) -> pd.DataFrame:
        seen = sum((counts(t) > 0).astype(np.int64) for t in part["t"])
        return pd.DataFrame({"l": [part["l"].iloc[0]], "n": [len(part)], "seen": [seen.tolist()]})

    found = sample.groupBy("l").applyInPandas(presence, "l string, n long, seen array<long>").collect()
    if not found:
        return LanguageModel((), np.ones(WIDTH), np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), np.zeros((0, SIZES)))
    total = sum(r.n for r in found)
    idf = np.log((1 + total) / (1 + sum(np.array(r.seen) for r in found))) + 1

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(part["t"])
        x = np.stack([vector(t, idf) for t in texts])
        centres = shared_centroids(x, centroids)
        usual = float(np.median((x @ centres.T).max(1)))
        below = bars(texts, x, centroids, idf, REJECT_SHARE * usual).tolist()
        return pd.DataFrame({"l": part["l"].iloc[0], "c": [c.tolist() for c in centres], "below": [below] * len(centres)})

    rows = sorted(sample.groupBy("l").applyInPandas(cluster, "l string, c array<float>, below array<double>").collect(), key=lambda r: (r.l, r.c))
    languages = tuple(sorted({r.l for r in rows}))
    below = {r.l: r.below for r in rows}
    return LanguageModel(languages, idf, np.array([r.c for r in rows], np.float32), np.array([languages.index(r.l) for r in rows]), np.array([below[x] for x in languages]))


def classify(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    at = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
    for lo in range(0, len(at), TEXTS):
        part = at[lo : lo + TEXTS]
        x = np.stack([vector(texts[i], model.idf) for i in part])
        cosines = x @ model.centroids.T
        by_language = np.stack([cosines[:, model.owner == j].max(1) for j in range(len(model.languages))], 1)
        best = by_language.argmax(1)
        for i, j, c, bar in zip(part, best.tolist(), np.clip(by_language.max(1), 0, 1).tolist(), model.reject_below[best, sizes(x)].tolist()):
            names[i], scores[i], rejected[i] = model.languages[j], c, c < bar
    return names, scores, rejected


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred, score, rejected`` (replaced if they are there): a pure map."""
    outputs = ("lang_pred", "score", "rejected")
    rest = [c for c in df.columns if c not in outputs or c == text]
    kept = df.select(*(df[c].alias(f"c{i}") for i, c in enumerate(rest)))
    at = rest.index(text)
    schema = ", ".join([*(f"c{i} {kind}" for i, (_, kind) in enumerate(kept.dtypes)), "p string, s double, r boolean"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            names, scores, rejected = classify(model, part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*part.schema.names, "p", "s", "r"])

    return arrow_map(kept, run, schema).toDF(*rest, *outputs)


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves a remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))
