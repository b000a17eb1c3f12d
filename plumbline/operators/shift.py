"""Drift between a reference and a test population."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.ordering import numbered
from plumbline.functions.quantiles import exact_quantiles
from plumbline.operators.boosting import auroc, out_of_fold
from plumbline.operators.neighbors import BLOCK, _blocks, knn, mean_distance, meetings, met_pairs, squared_distances


def melted(reference: DataFrame, test: DataFrame, vector: str, *keep: str) -> DataFrame:
    """``keep, dim, v, is_test``: the features of both populations."""
    part = lambda df, t: df.filter(F.col(vector).isNotNull()).select(*keep, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "v"), F.lit(t).alias("is_test"))
    return part(reference, 0).union(part(test, 1))


#: Parts that the values of a group are cut into.
PARTS = 64


def pooled(long: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values of each group with counts of both sides, below them and in all: ties are one row, so the windows
    run over values, not rows. A group's values are cut at approximate quantiles into parts that are summed up first, so
    no task holds all values of a group."""
    values = long.groupBy(*by, "v").agg(F.sum(F.lit(1) - F.col("is_test")).alias("r"), F.sum("is_test").alias("t"))
    group = F.struct(*by) if by else F.lit(0)
    cuts = values.groupBy(group.alias("g")).agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 1000).alias("cuts"))
    dealt = values.withColumn("g", group).join(F.broadcast(cuts), "g").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = dealt.groupBy("g", "part").agg(F.sum("r").alias("pr"), F.sum("t").alias("pt"))
    before, whole = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(F.col("g").alias("sg"), F.col("part").alias("sp"), zero(F.sum("pr").over(before)).alias("br"), zero(F.sum("pt").over(before)).alias("bt"), F.sum("pr").over(whole).alias("m"), F.sum("pt").over(whole).alias("n"))
    upto = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumn("cr", F.sum("r").over(upto)).withColumn("ct", F.sum("t").over(upto))
    out = inside.join(F.broadcast(sums), (F.col("g") == F.col("sg")) & (F.col("part") == F.col("sp")))
    return out.select(*by, "v", "r", "t", (F.col("cr") + F.col("br")).alias("cr"), (F.col("ct") + F.col("bt")).alias("ct"), "m", "n")


def ks(long: DataFrame, by: list[str], alternative: str = "two-sided") -> DataFrame:
    """``by, statistic, p_val``: Kolmogorov-Smirnov, asymptotic p. One-sided: ``greater`` if the reference's distribution
    function lies above the test's (its values are smaller), ``less`` if below."""
    gap = F.col("cr") / F.col("m") - F.col("ct") / F.col("n")
    over = {"two-sided": F.abs(gap), "greater": gap, "less": -gap}[alternative]
    out = pooled(long, by).groupBy(*by).agg(F.greatest(F.max(over), F.lit(0.0)).alias("statistic"), F.first("m").alias("m"), F.first("n").alias("n"))
    lam = F.col("statistic") * F.sqrt(F.col("m") * F.col("n") / (F.col("m") + F.col("n")))
    if alternative != "two-sided":
        return out.withColumn("p_val", F.exp(-2.0 * lam * lam))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda t, j: t + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam))
    return out.withColumn("p_val", F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))))


# Upper-tail probabilities of the limit distribution of the Cramer-von Mises statistic (x, p), published
# by Anderson and Darling (1952) and Csorgo and Faraway (1996).
CVM_POINTS = ((0.0, 1.0), (0.02480, 0.99), (0.03656, 0.95), (0.04601, 0.90), (0.06222, 0.80), (0.07026, 0.75), (0.11888, 0.50), (0.20939, 0.25), (0.24124, 0.20), (0.28406, 0.15), (0.34730, 0.10), (0.46136, 0.05), (0.58061, 0.025), (0.74346, 0.01), (1.16786, 0.001))


def cvm_p(x: str) -> str:
    """SQL: the upper tail at ``x``, between published points log-linear, beyond the last with its slope."""
    parts = []
    for (a, p), (b, q) in zip(CVM_POINTS, CVM_POINTS[1:]):
        slope = (math.log(q) - math.log(p)) / (b - a)
        line = f"exp({math.log(p)!r} + {slope!r} * ({x} - {a!r}))"
        parts.append(f"WHEN {x} < {b!r} THEN {line}" if b != CVM_POINTS[-1][0] else f"ELSE {line}")
    return f"CASE {' '.join(parts)} END"


def ad_p(x: str) -> str:
    """SQL: the upper tail of the limit distribution of the Anderson-Darling statistic, which that of Baumgartner, Weiss and
    Schindler shares, by the approximation of Marsaglia and Marsaglia (2004)."""
    low = f"exp(-1.2337141 / {x}) / sqrt({x}) * (2.00012 + (0.247105 - (0.0649821 - (0.0347962 - (0.0116720 - 0.00168691 * {x}) * {x}) * {x}) * {x}) * {x})"
    high = f"exp(-exp(1.0776 - (2.30695 - (0.43424 - (0.082433 - (0.008056 - 0.0003146 * {x}) * {x}) * {x}) * {x}) * {x}))"
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} < 2 THEN greatest(0.0, 1 - {low}) ELSE 1 - {high} END"


def normal_p(z: str) -> str:
    """SQL: the two-sided tail of the normal distribution (Abramowitz and Stegun 7.1.26, within 3e-7)."""
    t = f"(1 / (1 + 0.3275911 * (abs({z}) / sqrt(2))))"
    return f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z} / 2)"


def cvm(long: DataFrame, by: list[str]) -> DataFrame:
    """Two-sample Cramer-von Mises statistic T from the pooled distribution functions, asymptotic p."""
    p = pooled(long, by)
    gap = F.col("cr") / F.col("m") - F.col("ct") / F.col("n")
    out = p.groupBy(*by).agg(F.sum((F.col("r") + F.col("t")) * gap * gap).alias("s"), F.first("m").alias("m"), F.first("n").alias("n"))
    return out.withColumn("statistic", F.col("s") * F.col("m") * F.col("n") / F.pow(F.col("m") + F.col("n"), 2)).drop("s").withColumn("p_val", F.expr(cvm_p("statistic")))


def mwu(long: DataFrame, by: list[str], alternative: str = "two-sided") -> DataFrame:
    """Mann-Whitney U of the test side, z with tie correction, normal p. One-sided: ``less`` if the reference's values are
    smaller, ``greater`` if they are larger."""
    p = pooled(long, by)
    u = F.sum(F.col("t") * (F.col("cr") - F.col("r") + F.col("r") / 2.0))
    ties = F.sum(F.pow(F.col("r") + F.col("t"), 3) - (F.col("r") + F.col("t")))
    out = p.groupBy(*by).agg(u.alias("statistic"), ties.alias("ties"), F.first("m").alias("m"), F.first("n").alias("n"))
    total = F.col("m") + F.col("n")
    sigma = F.sqrt(F.col("m") * F.col("n") / 12.0 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = F.when(sigma > 0, (F.col("statistic") - F.col("m") * F.col("n") / 2.0) / sigma).otherwise(F.lit(0.0))
    out = out.withColumn("z", z).withColumn("p_val", F.expr(normal_p("z"))).drop("ties")
    if alternative == "two-sided":
        return out
    found = F.col("z") > 0 if alternative == "less" else F.col("z") < 0
    return out.withColumn("p_val", F.when(found, F.col("p_val") / 2).otherwise(1 - F.col("p_val") / 2))


def anderson(long: DataFrame, by: list[str]) -> DataFrame:
    """Two-sample Anderson-Darling statistic (midrank version for ties), asymptotic p."""
    p = pooled(long, by)
    total = F.col("m") + F.col("n")
    size = F.col("r") + F.col("t")
    below = F.col("cr") + F.col("ct") - size / 2.0
    term = lambda c, own, n: F.pow(total * (c - own / 2.0) - n * below, 2) / n
    weight = below * (total - below) - total * size / 4.0
    terms = F.when(weight > 0, size / total / weight * (term(F.col("cr"), F.col("r"), F.col("m")) + term(F.col("ct"), F.col("t"), F.col("n")))).otherwise(F.lit(0.0))
    out = p.groupBy(*by).agg(F.sum(terms).alias("s"), F.first("m").alias("m"), F.first("n").alias("n"))
    return out.withColumn("statistic", F.col("s") * (total - 1) / total).drop("s").withColumn("p_val", F.expr(ad_p("statistic")))


def bws(long: DataFrame, by: list[str]) -> DataFrame:
    """Baumgartner-Weiss-Schindler statistic B from the ranks of both sides (mid-ranks for ties), asymptotic p."""
    p = pooled(long, by)
    total = F.col("m") + F.col("n")
    rank = F.col("cr") + F.col("ct") - (F.col("r") + F.col("t") - 1) / 2.0

    def side(count: str, upto: str, own: str, other: str) -> Column:
        i = F.col(upto) - (F.col(count) - 1) / 2.0
        share = i / (F.col(own) + 1)
        return F.sum(F.col(count) * F.pow(rank - total / F.col(own) * i, 2) / (share * (1 - share) * F.col(other) * total / F.col(own))) / F.max(F.col(own))

    out = p.groupBy(*by).agg(((side("r", "cr", "m", "n") + side("t", "ct", "n", "m")) / 2).alias("statistic"), F.first("m").alias("m"), F.first("n").alias("n"))
    return out.withColumn("p_val", F.expr(ad_p("statistic")))


TESTS = {"ks": ks, "cvm": cvm, "mwu": mwu, "anderson": anderson, "bws": bws}


#: Tests that have one-sided forms.
ONE_SIDED = ("ks", "mwu")


def univariate(long: DataFrame, by: list[str], test: str = "ks", alternative: str = "two-sided") -> DataFrame:
    """A test by name in each group."""
    if test not in TESTS:
        raise ValueError(f"unknown test {test!r}; one of {sorted(TESTS)}")
    if alternative == "two-sided":
        return TESTS[test](long, by)
    if alternative not in ("less", "greater"):
        raise ValueError(f"unknown alternative {alternative!r}; one of two-sided, less, greater")
    if test not in ONE_SIDED:
        raise ValueError(f"{test} has no one-sided form; {', '.join(ONE_SIDED)} have")
    return TESTS[test](long, by, alternative)


def corrected(tests: DataFrame, p_val: float = 0.05, correction: str = "bonferroni", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``drifted`` a feature, in each group of ``by``: bonferroni compares with p over the features, fdr by Benjamini
    and Hochberg's step."""
    if "p_val" not in tests.columns:
        raise ValueError("a test without p-values can't say whether anything drifted")
    whole = Window.partitionBy(*by)
    d = F.count("*").over(whole)
    if correction == "bonferroni":
        return tests.withColumn("drifted", F.col("p_val") < p_val / d)
    if correction != "fdr":
        raise ValueError(f"unknown correction {correction!r}")
    rank = F.row_number().over(whole.orderBy("p_val"))
    passed = tests.withColumn("rank", rank).withColumn("ok", F.when(F.col("p_val") <= p_val * rank / d, F.col("rank")))
    return passed.withColumn("drifted", F.col("rank") <= F.coalesce(F.max("ok").over(whole), F.lit(0))).drop("rank", "ok")


def mmd2(x: np.ndarray, y: np.ndarray, permutations: int = 0, seed: int = 1, block: int = 1024) -> tuple[float, float]:
    """Unbiased MMD^2 with a Gaussian kernel of median bandwidth, and its permutation p (blocked; for bounded samples)."""
    z = np.concatenate([x, y])
    sq = (z * z).sum(1)
    d2 = np.maximum(sq[:, None] + sq[None, :] - 2 * z @ z.T, 0)
    sigma2 = np.median(d2[np.triu_indices(len(z), 1)]) or 1.0
    k = np.exp(-d2 / (2 * sigma2))
    np.fill_diagonal(k, 0)

    def stat(side: np.ndarray) -> float:
        m, n = (~side).sum(), side.sum()
        rows = k @ side
        yy, xy = rows[side].sum(), rows[~side].sum()
        xx = k.sum() - yy - 2 * xy
        return float(xx / (m * (m - 1)) + yy / (n * (n - 1)) - 2 * xy / (m * n))

    side = np.arange(len(z)) >= len(x)
    seen = stat(side)
    rng = np.random.default_rng(seed)
    more = sum(stat(rng.permutation(side)) >= seen for _ in range(permutations))
    return seen, (1 + more) / (1 + permutations)


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """``b, s, b2, s2, d2``: two blocks, their sides and their squared distances; a block with itself too."""

    def ready(row: tuple) -> tuple:
        b, x, s = row
        s = np.frombuffer(s, np.int64)
        return b, np.frombuffer(x, np.float64).reshape(len(s), -1), s

    for (i, x, s), (j, x2, s2) in met_pairs(batches, ready):
        yield i, s, j, s2, squared_distances(x, x2)


#: Ranges that a pass over all distances counts.
RANGES = 1 << 18


def _median_distance(met: DataFrame, top: float, pairs: int) -> float:
    """The median of the squared distances of all pairs, none above ``top``, to within top / RANGES**2 (less is 0): one
    pass counts them in ranges, another in parts of the ranges that hold the middle ones."""
    width = top / RANGES

    def counted(within: list[int]) -> np.ndarray:
        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((max(1, len(within)), RANGES), np.int64)
            for i, _, j, _, d in _met(batches):
                d = (d[np.triu_indices(len(d), 1)] if i == j else d.ravel()) / width
                at = np.minimum(d, RANGES - 1).astype(np.int64)
                if not within:
                    seen[0] += np.bincount(at, minlength=RANGES)
                for row, k in enumerate(within):
                    part = np.minimum((d[at == k] - k) * RANGES, RANGES - 1).astype(np.int64)
                    seen[row] += np.bincount(part, minlength=RANGES)
            row, at = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(at), pa.array(seen[row, at])], ["row", "at", "n"])

        found = met.mapInArrow(count, "row long, at long, n long").groupBy("row", "at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((max(1, len(within)), RANGES), np.int64)
        out[found["row"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
        return out

    upto = np.cumsum(counted([])[0])
    ranks = [(pairs - 1) // 2, pairs // 2]
    ranges = [int(np.searchsorted(upto, r, side="right")) for r in ranks]
    within = sorted(set(ranges))
    parts = dict(zip(within, np.cumsum(counted(within), axis=1)))
    values = []
    for r, k in zip(ranks, ranges):
        part = int(np.searchsorted(parts[k], r - (upto[k - 1] if k else 0), side="right"))
        values.append((k + (part + 0.5) / RANGES) * width if k or part else 0.0)
    return sum(values) / 2


def drift_mmd(reference: DataFrame, test: DataFrame, key: str, vector: str, permutations: int = 100, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``mmd2, p_val, drifted`` over all rows: unbiased MMD^2 with a Gaussian kernel of median bandwidth, and its
    permutation p. Kernel sums are taken in blocks of both sides that meet by block number. Permutations change sides
    within blocks, whose rows a hash of the key has dealt: each is as likely as the true sides if nothing drifted."""
    both = reference.select(key, vector, F.lit(0).alias("side")).union(test.select(key, vector, F.lit(1).alias("side"))).filter(F.col(vector).isNotNull() & F.col(key).isNotNull())
    square = F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda t, v: t + v * v)
    n, m, longest = both.agg(F.sum("side"), F.count("*") - F.sum("side"), F.max(square)).first()
    blocks, count = _blocks(both, key, vector, block, "side")
    met = meetings(blocks.checkpoint(), count, "x", "s")
    sigma2 = (_median_distance(met, 4 * longest, (m + n) * (m + n - 1) // 2) if longest else 0.0) or 1.0

    def sides(b: int, s: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([seed, b])
        return np.stack([s, *(rng.permutation(s) for _ in range(permutations))], 1).astype(np.float64)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yy, xy, whole = np.zeros(1 + permutations), np.zeros(1 + permutations), 0.0
        for i, s, j, s2, k in _met(batches):
            k /= -2 * sigma2
            np.exp(k, out=k)
            if i == j:
                np.fill_diagonal(k, 0)
            one, two = sides(i, s), sides(j, s2)
            inside = (one * (k @ two)).sum(0)
            across = k.sum(0) @ two - inside
            if i != j:
                across += k.sum(1) @ one - inside
            yy, xy, whole = yy + inside * (1 + (i != j)), xy + across, whole + k.sum() * (1 + (i != j))
        yield pa.RecordBatch.from_arrays([pa.array([yy.tolist()]), pa.array([xy.tolist()]), pa.array([whole])], ["yy", "xy", "whole"])

    found = met.mapInArrow(sums, "yy array<double>, xy array<double>, whole double").collect()
    yy, xy, whole = (np.sum([r[c] for r in found], axis=0) for c in ("yy", "xy", "whole"))
    values = (whole - yy - 2 * xy) / (m * (m - 1)) + yy / (n * (n - 1)) - 2 * xy / (m * n)
    p = float((1 + (values[1:] >= values[0]).sum()) / (1 + permutations))
    return reference.sparkSession.createDataFrame([(float(values[0]), p, p < 0.05)], "mmd2 double, p_val double, drifted boolean")


def chunks(df: DataFrame, order: str, size: int | None = None, count: int | None = None, incomplete: str = "keep") -> DataFrame:
    """Adds ``chunk`` (from 0) in order. Exactly one of size and count; the last, incomplete chunk of a size is kept,
    dropped or appended to the one before."""
    if (size is None) == (count is None):
        raise ValueError("give exactly one of size and count")
    if incomplete not in ("keep", "drop", "append"):
        raise ValueError(f"unknown treatment of incomplete chunks {incomplete!r}")
    placed = numbered(df, order, order, "__at").withColumn("__at", F.col("__at") - 1).crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))
    if count is not None:
        return placed.withColumn("chunk", F.floor(F.col("__at") * count / F.col("__n")).cast("long")).drop("__at", "__n")
    out = placed.withColumn("chunk", F.floor(F.col("__at") / size).cast("long"))
    whole = F.floor(F.col("__n") / size).cast("long")
    if incomplete == "drop":
        out = out.filter(F.col("chunk") < whole)
    elif incomplete == "append":
        out = out.withColumn("chunk", F.when(whole > 0, F.least("chunk", whole - 1)).otherwise(F.col("chunk")))
    return out.drop("__at", "__n")


def chunk_drift(reference: DataFrame, test: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """``chunk, value, lower_threshold, upper_threshold, drifted``: a chunk's value against mean +- multiplier * std
    (population) of the reference's chunks. Both: chunk, value."""
    band = reference.agg((F.avg("value") - multiplier * F.stddev_pop("value")).alias("lower_threshold"), (F.avg("value") + multiplier * F.stddev_pop("value")).alias("upper_threshold"))
    return test.crossJoin(F.broadcast(band)).withColumn("drifted", (F.col("value") < F.col("lower_threshold")) | (F.col("value") > F.col("upper_threshold")))


def classwise(reference: DataFrame, test: DataFrame, label: str, value: str, method: str = "ks", least: int = 2) -> DataFrame:
    """A univariate test in each class that has ``least`` rows on both sides."""
    part = lambda df, t: df.filter(F.col(label).isNotNull() & F.col(value).isNotNull()).select(F.col(label).cast("string").alias("class_name"), F.col(value).cast("double").alias("v"), F.lit(t).alias("is_test"))
    return TESTS[method](part(reference, 0).union(part(test, 1)), ["class_name"]).filter((F.col("m") >= least) & (F.col("n") >= least))


def in_chunks(reference: DataFrame, test: DataFrame, vector: str, order: str, size: int | None = None, count: int | None = None, incomplete: str = "keep") -> DataFrame:
    """The rows of both sides that lie in a chunk: ``chunk`` (the test's from 0 on, the reference's from -1 down),
    ``position`` (in its side, from 0), ``order``, ``vector``."""
    sides = []
    for df, sign in ((reference, -1), (test, 1)):
        rows = df.filter(F.col(vector).isNotNull() & F.col(order).isNotNull()).select(order, F.col(vector).cast("array<double>").alias(vector))
        placed = numbered(chunks(rows, order, size, count, incomplete), order, order, "position").withColumn("position", F.col("position") - 1)
        sides.append(placed.withColumn("chunk", F.col("chunk") if sign > 0 else -1 - F.col("chunk")))
    return sides[0].unionByName(sides[1])


def chunk_spans(rows: DataFrame) -> DataFrame:
    """``chunk, start_index, end_index`` (the first row and the one behind the last)."""
    return rows.groupBy("chunk").agg(F.min("position").alias("start_index"), (F.max("position") + 1).alias("end_index"))


def univariate_chunks(reference: DataFrame, rows: DataFrame, vector: str, test: str = "ks") -> DataFrame:
    """``chunk, value``: a chunk's test statistic against the whole reference (of mwu the size of z), on average over the
    features. ks and mwu need of the reference only how many of its values lie below each value of a chunk: its values are
    ranked once for all chunks. The others weigh every value of the reference by the chunk's: it is met by each."""
    long = lambda df, *keep: df.filter(F.col(vector).isNotNull()).select(*keep, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "v"))
    if test not in ("ks", "mwu"):
        each = rows.select("chunk").distinct()
        both = long(reference).crossJoin(F.broadcast(each)).select("chunk", "dim", "v", F.lit(0).alias("is_test")).union(long(rows, "chunk").withColumn("is_test", F.lit(1)))
        return univariate(both, ["chunk", "dim"], test).groupBy("chunk").agg(F.avg("statistic").alias("value"))
    known = pooled(long(reference).withColumn("is_test", F.lit(0)).unionByName(long(rows).withColumn("is_test", F.lit(1))), ["dim"])
    own = pooled(long(rows, "chunk").withColumn("is_test", F.lit(1)), ["chunk", "dim"]).select("chunk", "dim", "v", "t", "ct", F.col("n").alias("n"))
    met = own.join(known.filter("t > 0").select("dim", "v", "r", "cr", "m"), ["dim", "v"])
    if test == "ks":
        after = F.abs(F.col("ct") / F.col("n") - F.col("cr") / F.col("m"))
        before = F.abs((F.col("ct") - F.col("t")) / F.col("n") - (F.col("cr") - F.col("r")) / F.col("m"))
        by_dim = met.groupBy("chunk", "dim").agg(F.max(F.greatest(after, before)).alias("s"))
        return by_dim.groupBy("chunk").agg(F.avg("s").alias("value"))
    cube = lambda c: c * c * c - c
    tied = known.groupBy("dim").agg(F.sum(cube(F.col("r").cast("double"))).alias("ties"))
    sums = met.groupBy("chunk", "dim").agg(F.sum(F.col("t") * (F.col("cr") - F.col("r") / 2.0)).alias("u"), F.sum(cube((F.col("r") + F.col("t")).cast("double")) - cube(F.col("r").cast("double"))).alias("more"), F.first("m").alias("m"), F.first("n").alias("n"))
    total = F.col("m") + F.col("n")
    sigma = F.sqrt(F.col("m") * F.col("n") / 12.0 * (total + 1 - (F.col("ties") + F.col("more")) / (total * (total - 1))))
    z = F.when(sigma > 0, F.abs(F.col("u") - F.col("m") * F.col("n") / 2.0) / sigma).otherwise(F.lit(0.0))
    return sums.join(tied, "dim").groupBy("chunk").agg(F.avg(z).alias("value"))


def mmd_chunks(reference: DataFrame, rows: DataFrame, vector: str, block: int = BLOCK) -> DataFrame:
    """``chunk, value``: unbiased MMD^2 of each chunk and the whole reference, of which the reference's chunks are parts. One
    meeting of all blocks gives every chunk's kernel sums; the bandwidth is the median over all rows."""
    if "chunk" not in rows.columns:
        raise ValueError("rows without chunks")
    # those of the reference that are in no chunk take part as reference: they have a chunk of their own
    none = -(1 << 40)
    kept = rows.filter("chunk < 0").select("position")
    order = rows.columns[0]
    rest = numbered(reference.filter(F.col(vector).isNotNull() & F.col(order).isNotNull()), order, order, "position").withColumn("position", F.col("position") - 1)
    rest = rest.join(kept, "position", "left_anti").select(F.col("position"), F.col(vector).cast("array<double>").alias(vector), F.lit(none).alias("chunk"))
    every = rows.select("position", vector, "chunk").unionByName(rest)
    # a row's name: its place in its side
    every = every.withColumn("name", F.when(F.col("chunk") < 0, -1 - F.col("position")).otherwise(F.col("position"))).checkpoint()
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda t, v: t + v * v)
    n, longest = every.agg(F.count("*"), F.max(square)).first()
    blocks, count = _blocks(every, "name", vector, block, "chunk")
    met = meetings(blocks.checkpoint(), count, "x", "s")
    sigma2 = (_median_distance(met, 4 * longest, n * (n - 1) // 2) if longest else 0.0) or 1.0

    def by_chunk(values: np.ndarray, chunk: np.ndarray) -> Iterator[tuple[int, float]]:
        names, at = np.unique(chunk, return_inverse=True)
        yield from zip(names.tolist(), np.bincount(at, values, len(names)).tolist())

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, float] = {}
        cross: dict[int, float] = {}
        for i, s, j, s2, k in _met(batches):
            k /= -2 * sigma2
            np.exp(k, out=k)
            if i == j:
                np.fill_diagonal(k, 0)
            times = 1 + (i != j)
            for c, v in by_chunk(k @ (s2 < 0).astype(float), s):
                cross[c] = cross.get(c, 0.0) + v
            if i != j:
                for c, v in by_chunk((s < 0).astype(float) @ k, s2):
                    cross[c] = cross.get(c, 0.0) + v
            same = np.where(s[:, None] == s2[None, :], k, 0.0).sum(1)
            for c, v in by_chunk(same, s):
                own[c] = own.get(c, 0.0) + times * v
        names = sorted({*own, *cross})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([own.get(c, 0.0) for c in names], pa.float64()), pa.array([cross.get(c, 0.0) for c in names], pa.float64())], ["chunk", "own", "crossed"])

    found = met.mapInArrow(sums, "chunk long, own double, crossed double").groupBy("chunk").agg(F.sum("own").alias("own"), F.sum("crossed").alias("crossed"))
    sizes = every.groupBy("chunk").agg(F.count("*").alias("size")).join(found, "chunk", "left").checkpoint()
    # all pairs of the reference: what its chunks have with it; a chunk of it meets its own rows, one of which is itself
    m, inside = sizes.filter("chunk < 0").agg(F.sum("size"), F.sum("crossed")).first()
    with_itself = F.when(F.col("chunk") < 0, F.col("size")).otherwise(0)
    value = F.lit(inside / (m * (m - 1.0))) + F.col("own") / (F.col("size") * (F.col("size") - 1.0)) - 2 * (F.col("crossed") + with_itself) / (F.col("size") * float(m))
    return sizes.filter((F.col("chunk") != none) & (F.col("size") > 1)).select("chunk", value.alias("value"))


def knn_chunks(reference: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """``chunk, value``: the mean distance of a chunk's rows to their k nearest of the reference (themselves left out)."""
    known = reference.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    out = None
    for side, itself in ((rows.filter("chunk < 0"), True), (rows.filter("chunk >= 0"), False)):
        near = mean_distance(knn(side.select(key, vector), known, key, vector, k, exclude_self=itself), key)
        part = near.join(side.select(key, "chunk"), key).groupBy("chunk").agg(F.avg("score").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def classifier_chunks(scored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``chunk, value``: the AUROC at which the out-of-fold probabilities of ``domain_classifier`` tell a chunk's rows from
    the whole reference."""
    side = F.when(F.col("chunk") < 0, 0.0).otherwise(1.0)
    tagged = rows.select(F.col(key).alias("k"), "chunk", side.alias("side"))
    own = scored.join(tagged, (F.col(key) == F.col("k")) & (F.col("label") == F.col("side"))).select("chunk", F.array("probability").alias("p"))
    known = scored.filter("label = 0").select(F.array("probability").alias("p"))
    long = lambda df, *keep: df.select(*keep, F.posexplode("p").alias("dim", "v"))
    ranks = pooled(long(known).withColumn("is_test", F.lit(0)).unionByName(long(own).withColumn("is_test", F.lit(1))), ["dim"]).filter("t > 0")
    met = long(own, "chunk").groupBy("chunk", "v").agg(F.count("*").alias("t")).join(ranks.select("v", "r", "cr", "m"), "v")
    return met.groupBy("chunk").agg((F.sum(F.col("t") * (F.col("cr") - F.col("r") / 2.0)) / F.sum(F.col("t") * F.col("m"))).alias("value"))


def domain_classifier(reference: DataFrame, test: DataFrame, key: str, vector: str, folds: int = 5, threshold: float = 0.55, repeats: int = 1) -> tuple[float, bool, DataFrame]:
    """Cross-validated AUROC of boosted trees that tell test from reference, whether it is over the threshold, and every
    row's out-of-fold probability of being test (``label`` 1). Folds are hashes of the key; all are grown together."""
    part = lambda df, t: df.select(key, vector, F.lit(t).alias("label"))
    scored = out_of_fold(part(reference, 0).union(part(test, 1)), key, vector, "label", folds, repeats).checkpoint()
    found = auroc(scored, "label", "probability")
    return found, found > threshold, scored


def factor_deviations(reference: DataFrame, flagged: DataFrame, key: str, factors: list[str]) -> DataFrame:
    """``key, factor, deviation``: robust z of the flagged rows' factors against the reference, largest first a row."""
    long = reference.select(*(F.col(f).cast("double").alias(f) for f in factors)).unpivot([], factors, "factor", "v")
    usual = exact_quantiles(long, "factor", "v", [0.25, 0.5, 0.75]).select(F.col("factor").alias("f"), "q")
    rows = flagged.select(key, *(F.col(f).cast("double").alias(f"__{f}") for f in factors)).unpivot([key], [f"__{f}" for f in factors], "factor", "v").withColumn("factor", F.expr("substring(factor, 3)"))
    z = F.when(F.col("q")[2] > F.col("q")[0], F.abs(F.col("v") - F.col("q")[1]) / ((F.col("q")[2] - F.col("q")[0]) / 1.349)).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(usual), F.col("factor") == F.col("f")).select(key, "factor", F.round(z, 4).alias("deviation"))


def factor_predictors(df: DataFrame, flag: str, factors: list[str], bins: int = 10) -> DataFrame:
    """``factor, mi_bits``: mutual information of each factor's quantile code with the flag, in bits (4 decimals)."""
    from plumbline.operators.encoding import uniform_counts
    from plumbline.operators.labels import mutual_information, pair_tables

    cut = uniform_counts(df, factors, bins)
    coded = df.select(F.col(flag).cast("string").alias("flag"), *(cut[f].code(F.col(f)).alias(f) for f in factors))
    out = mutual_information(pair_tables(coded, [("flag", f) for f in factors]))
    return out.select(F.col("y_name").alias("factor"), F.round(F.col("mi") / math.log(2), 4).alias("mi_bits"))


def ood_domain_classifier(reference: DataFrame, test: DataFrame, key: str, vector: str, folds: int = 5, repeats: int = 5, n_std: float = 2.0) -> DataFrame:
    """``key, score, threshold, is_ood``: mean out-of-fold probability of being test over repeated folds, against mean +
    n_std * std of the reference's own."""
    mean = domain_classifier(reference, test, key, vector, folds, repeats=repeats)[2].withColumnRenamed("probability", "score")
    limit = mean.filter("label = 0").agg((F.avg("score") + n_std * F.stddev_pop("score")).alias("threshold"))
    return mean.filter("label = 1").crossJoin(F.broadcast(limit)).select(key, "score", "threshold", (F.col("score") > F.col("threshold")).alias("is_ood"))
