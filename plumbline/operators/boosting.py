"""Boosted trees that tell two sides apart, all folds at once.

Features are cut at quantiles into at most ``BINS`` codes, rows packed in blocks. A model is grown for each fold, from the
rows outside it: a pass over the blocks sums gradients by model, node, feature and code (a matrix of bounded size, whatever
the rows), the best split of every node follows from the sums, and the next level needs the next pass. What a row's trees
say so far is worked out anew in each pass, so nothing but the trees is kept between passes and a lost executor costs its
blocks alone. Numbers of passes, trees and sums don't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of a feature, levels and number of trees, their weight, and the prior of a leaf.
BINS, DEPTH, TREES, RATE, PRIOR = 32, 3, 20, 0.3, 1.0
#: Rows of a block.
BLOCK = 4096


@dataclass
class Trees:
    """Of each model: trees of full depth as arrays (feature, the last code that goes left) by node, and leaf values."""

    models: int
    feature: list[np.ndarray] = field(default_factory=list)  # a tree: models x (2**DEPTH - 1)
    code: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)  # a tree: models x 2**DEPTH

    def places(self, x: np.ndarray, model: int, tree: int, levels: int) -> np.ndarray:
        """The node of each row (its number within the level) after ``levels`` splits."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(levels):
            node = (1 << level) - 1 + at
            at = 2 * at + (x[rows, self.feature[tree][model, node]] > self.code[tree][model, node])
        return at

    def margins(self, x: np.ndarray, model: int, trees: int) -> np.ndarray:
        out = np.zeros(len(x))
        for t in range(trees):
            out += self.leaf[t][model, self.places(x, model, t, DEPTH)]
        return out


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sums (node, feature, code, 2: gradients and weights), the feature and code of each node's best split (the first of
    equally good ones), and the sums of its two sides. A node that no split improves sends all its rows left."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + PRIOR)
    gain = score(left) + score(right) - score(whole)
    gain[:, :, -1] = 0.0
    gain = np.round(gain, 8)  # sums come in any order: what differs by that alone is equally good
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    feature, code = np.divmod(best, gain.shape[2])
    none = flat[np.arange(len(flat)), best] <= 0
    code = np.where(none, gain.shape[2] - 1, code)  # all codes are at most that
    feature = np.where(none, 0, feature)
    node = np.arange(len(flat))
    return feature, code, np.stack([left[node, feature, code], right[node, feature, code]], 1)


def blocks_of(rows: DataFrame, cuts: np.ndarray, repeats: int, folds: int) -> DataFrame:
    """``x`` (codes), ``y`` and ``fold`` (by repeat) of packed rows, and their keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1).astype(np.uint8)
                fold = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), *(pa.array([a.tobytes()], pa.binary()) for a in (codes, part.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), fold))], ["k", "x", "y", "fold"])

    fold = F.array(*(F.pmod(F.xxhash64(F.lit(s + 1), "k"), F.lit(folds)).cast("int") for s in range(repeats)))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.select("k", "x", "y", fold.alias("fold")).mapInArrow(run, f"k array<{kind}>, x binary, y binary, fold binary")


def out_of_fold(data: DataFrame, key: str, vector: str, label: str, folds: int = 5, repeats: int = 1, trees: int = TREES) -> DataFrame:
    """``key, label, probability``: the mean, over ``repeats``, of what the model that hasn't seen a row says of label 1.
    Folds are hashes of the key. Rows without a key or vector are left out; a feature without differences splits nothing."""
    rows = data.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")).checkpoint()
    cuts_of = F.percentile_approx("v", [i / BINS for i in range(1, BINS)], 1000)
    found = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(cuts_of.alias("cuts")).orderBy("dim").collect()
    if not found:
        return rows.select(F.col("k").alias(key), F.col("y").alias(label), F.lit(0.5).alias("probability"))
    cuts = [np.unique(np.array(r.cuts, np.float64)) for r in found]
    width, models = len(cuts), folds * repeats
    packed = blocks_of(rows, cuts, repeats, folds).checkpoint()
    grown = Trees(models)

    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, x, y, fold in zip(*(batch.column(i).to_pylist() for i in range(4))):
            yield k, np.frombuffer(x, np.uint8).reshape(-1, width), np.frombuffer(y, np.uint8).astype(float), np.frombuffer(fold, np.uint8).reshape(-1, repeats)

    def total(level: int, tree: int) -> np.ndarray:
        """Sums of gradients and weights by model, node, feature and code."""
        nodes = 1 << level
        shape = (models, nodes, width, BINS, 2)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(shape)
            for batch in batches:
                for _, x, y, fold in unpacked(batch):
                    for m in range(models):
                        use = fold[:, m // folds] != m % folds
                        mine = x[use]
                        p = 1 / (1 + np.exp(-grown.margins(mine, m, tree)))
                        g, h = y[use] - p, p * (1 - p)
                        at = grown.places(mine, m, tree, level)
                        for f in range(width):
                            cell = at * BINS + mine[:, f]
                            held[m, :, f, :, 0] += np.bincount(cell, g, nodes * BINS).reshape(nodes, BINS)
                            held[m, :, f, :, 1] += np.bincount(cell, h, nodes * BINS).reshape(nodes, BINS)
            for m in range(models):
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([held[m].tobytes()], pa.binary())], ["m", "sums"])

        def add(table: pa.Table) -> pa.Table:
            whole = np.sum([np.frombuffer(s, np.float64) for s in table["sums"].to_pylist()], axis=0)
            return pa.table({"m": table["m"].slice(0, 1), "sums": pa.array([whole.tobytes()], pa.binary())})

        out = np.zeros(shape)
        for r in packed.mapInArrow(run, "m int, sums binary").groupBy("m").applyInArrow(add, "m int, sums binary").collect():
            out[r.m] = np.frombuffer(r.sums, np.float64).reshape(shape[1:])
        return out

    for tree in range(trees):
        grown.feature.append(np.zeros((models, (1 << DEPTH) - 1), np.int64))
        grown.code.append(np.full((models, (1 << DEPTH) - 1), BINS, np.int64))
        leaves = np.zeros((models, 1 << DEPTH, 2))
        for level in range(DEPTH):
            sums = total(level, tree)
            nodes = slice((1 << level) - 1, (1 << level + 1) - 1)
            for m in range(models):
                grown.feature[tree][m, nodes], grown.code[tree][m, nodes], sides = best_splits(sums[m])
                if level == DEPTH - 1:  # the sides of the last splits are the leaves
                    leaves[m] = sides.reshape(-1, 2)
        grown.leaf.append(RATE * leaves[..., 0] / (leaves[..., 1] + PRIOR))

    kind = rows.schema["k"].dataType.simpleString()

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x, y, fold in unpacked(batch):
                p = np.zeros(len(x))
                for m in range(models):
                    held = fold[:, m // folds] == m % folds
                    p[held] += 1 / (1 + np.exp(-grown.margins(x[held], m, trees))) / repeats
                yield pa.RecordBatch.from_arrays([pa.array(k, batch.column(0).type.value_type), pa.array(y.astype(np.int32)), pa.array(p)], ["k", "y", "p"])

    return packed.mapInArrow(scored, f"k {kind}, y int, p double").toDF(key, label, "probability")


def auroc(scored: DataFrame, label: str, score: str) -> float:
    """The share of pairs of the two labels that the score puts in order, ties as halves; 0.5 without pairs."""
    from plumbline.operators.shift import pooled

    long = scored.select(F.col(score).alias("v"), F.col(label).alias("is_test"))
    row = pooled(long, []).agg(F.sum(F.col("t") * (F.col("cr") - F.col("r") / 2.0)).alias("u"), F.max("m").alias("m"), F.max("n").alias("n")).first()
    return float(row.u / (row.m * row.n)) if row.m and row.n else 0.5
