"""Exact k nearest neighbours in blocks, and what rests on them: coverage, dispersion, OOD scores, prioritization.

Both sides are packed into blocks of ``BLOCK`` vectors and sent to the cells of a grid, queries along its rows, references
along its columns: a block moves once for each of a few rows or columns, not for each block that it meets. In a cell products
of matrices give each query's best k over the cell's references, and this partial top-k goes on. No pair is ever a row. The
result is exact and costs queries times references; for approximate search at scale an index belongs in front. Spanning
trees are exact too, by Boruvka rounds on neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.ordering import numbered, renumbered
from plumbline.functions.quantiles import exact_quantiles, quantile

BLOCK = 2048
#: Blocks that a task holds.
HELD = 32
#: Parts that blocks are dealt into so that all cores have work.
WAYS = 16


def _blocks(df: DataFrame, key: str, vector: str, block: int, side: str | None = None) -> tuple[DataFrame, int]:
    """Rows dealt by hash of the key and packed: ``b, k, x``, with ``side`` also ``s``; and how many blocks."""
    carried = [F.col(side).cast("long").alias("s")] if side else []
    rows = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("x"), *carried)
    count = max(1, math.ceil(rows.count() / block))

    def pack(table: pa.Table) -> pa.Table:
        k, s = table["k"].to_numpy(), [table["s"].to_numpy()] if side else []
        order = np.lexsort((*s, k))
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)[order]
        packed = {"b": pa.array([table["b"][0].as_py()], pa.int32()), "k": [k[order].tobytes()], "x": [np.ascontiguousarray(x).tobytes()]}
        return pa.table(packed | ({"s": [s[0][order].tobytes()]} if side else {}))

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(count)).cast("int"))
    return dealt.groupBy("b").applyInArrow(pack, "b int, k binary, x binary" + ", s binary" * bool(side)), count


def opened(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, vectors and groups of a block, without rows that are not finite."""
    k, x, s = row
    names = np.frombuffer(k, np.int64)
    x, s = np.frombuffer(x, np.float64).reshape(len(names), -1), np.frombuffer(s, np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        sound = np.isfinite((x * x).sum(1))
    return (names, x, s) if sound.all() else (names[sound], x[sound], s[sound])


class Known:
    """A block made ready for products: ``x, 1`` against ``y, -y * y / 2`` (cosine: unit vectors) is larger for nearer
    rows. With ``core`` the first component is a distance that the row is no nearer than to any other."""

    def __init__(self, row: tuple, cosine: bool, core: bool) -> None:
        self.names, x, self.groups = opened(row)
        self.core, self.x = (x[:, 0], np.ascontiguousarray(x[:, 1:])) if core else (None, x)
        self.square = (self.x * self.x).sum(1)
        self.norm = np.sqrt(self.square)
        self.longest = float(self.norm.max()) if len(x) else 0.0
        self.unit = self.x / np.maximum(self.norm, 1e-300)[:, None] if cosine else None
        self.made: dict = {}

    def factor(self, kind: type, asks: bool) -> np.ndarray:
        """One side of the product, rounded to ``kind``."""
        if (kind, asks) not in self.made:
            more = np.ones(len(self.x)) if asks else -self.square / 2
            self.made[kind, asks] = (np.column_stack([self.x, more]) if self.unit is None else self.unit).astype(kind)
        return self.made[kind, asks]


class Nearest:
    """The best k of a query block over the reference blocks that it meets one after the other.

    Once k are known, only rows that are no farther than the k-th can be better: a product of matrices, in single
    precision where its rounding is small beside that distance, and a comparison with a bound that allows for all
    rounding find them; their distances are then taken term by term in double precision."""

    ROWS, PAIRS = 512, 1 << 16

    def __init__(self, asking: Known, k: int, exclude_self: bool, within: bool, apart: bool) -> None:
        self.q, self.k, self.exclude_self, self.within, self.apart = asking, k, exclude_self, within, apart
        self.d = np.full((len(asking.x), k), np.inf)
        self.n = np.full((len(asking.x), k), np.iinfo(np.int64).max)

    def distances(self, r: Known, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        q, out = self.q, np.empty(len(i))
        for lo in range(0, len(i), self.PAIRS):
            a, b = i[lo : lo + self.PAIRS], j[lo : lo + self.PAIRS]
            if q.unit is None:
                out[lo : lo + self.PAIRS] = np.sqrt(((q.x[a] - r.x[b]) ** 2).sum(1))
            else:
                out[lo : lo + self.PAIRS] = 1 - (q.x[a] * r.x[b]).sum(1) / np.maximum(q.norm[a] * r.norm[b], 1e-300)
        return out if q.core is None else np.maximum(out, np.maximum(q.core[i], r.core[j]))

    def allowed(self, r: Known, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = self.q.groups[i] == r.groups[j]
        return same if self.within else ~same

    def add(self, r: Known, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs, none of them known yet, compete with the best so far."""
        if (self.within or self.apart) and len(i):
            use = self.allowed(r, i, j)
            i, j = i[use], j[use]
        d = self.distances(r, i, j)
        use = np.isfinite(d) & (d <= self.d[i, -1])
        i, j, d = i[use], j[use], d[use]
        if not len(i):
            return
        rows, at = np.unique(i, return_inverse=True)
        q = np.concatenate([at, np.repeat(np.arange(len(rows)), self.k)])
        d, n = np.concatenate([d, self.d[rows].ravel()]), np.concatenate([r.names[j], self.n[rows].ravel()])
        order = np.lexsort((n, d, q))
        heads = np.cumsum(np.append(0, np.bincount(q)[:-1]))
        best = order[heads[:, None] + np.arange(self.k)]
        self.d[rows], self.n[rows] = d[best], n[best]

    def meet(self, r: Known) -> None:
        if not len(r.x):
            return
        q, width = self.q, len(r.x)
        for lo in range(0, len(q.x), self.ROWS):
            hi = min(lo + self.ROWS, len(q.x))
            norm, square = q.norm[lo:hi], q.square[lo:hi]
            hidden = np.zeros((0, 2), np.int64)
            if self.exclude_self:
                first, last = (np.searchsorted(r.names, q.names[lo:hi], side) for side in ("left", "right"))
                hidden = np.array([(i, j) for i in np.flatnonzero(last > first) for j in range(first[i], last[i])], np.int64).reshape(-1, 2)

            def product(kind: type) -> np.ndarray:
                g = q.factor(kind, True)[lo:hi] @ r.factor(kind, False).T
                g[hidden[:, 0], hidden[:, 1]] = -np.inf
                return g

            def rounding(kind: type) -> np.ndarray:
                much = (q.x.shape[1] + 8) * np.finfo(kind).eps
                return much * (4.0 if q.unit is not None else norm * r.longest + r.longest**2 + square)

            fits = max(q.longest, r.longest) < 1e15  # in single precision, squared
            kind = np.float32 if fits else np.float64
            g = product(kind)
            new = np.flatnonzero(np.isinf(self.d[lo:hi, -1]))
            if len(new):  # any k give a bound
                part = g[new]
                if self.within or self.apart:
                    same = q.groups[lo + new][:, None] == r.groups[None, :]
                    part[~same if self.within else same] = -np.inf
                m = min(self.k + 8, width)
                at = np.argpartition(part, width - m, axis=1)[:, width - m :]
                i, j = np.repeat(np.arange(len(new)), m), at.ravel()
                use = part[i, j] > -np.inf
                i, j = new[i[use]], j[use]
                self.add(r, lo + i, j)
                hidden = np.concatenate([hidden, np.column_stack([i, j])])
                g[i, j] = -np.inf
            t = self.d[lo:hi, -1]
            some = np.isfinite(t)  # of the others all pairs are known
            if not some.any() or width <= self.k + 8 and len(new) == hi - lo:
                continue
            t = np.where(some, t, 0.0)
            if kind is np.float32 and np.median(np.broadcast_to(rounding(kind), t.shape)[some]) > 1e-3 * np.median(t[some] if q.unit is not None else t[some] ** 2):
                kind = np.float64
                g = product(kind)
            slack = rounding(kind) + (q.x.shape[1] + 8) * np.finfo(kind).eps * t**2
            least = (1 - t if q.unit is not None else (square - t**2) / 2) - slack
            near = g >= np.where(some, least, np.inf).astype(kind)[:, None]
            i, j = np.divmod(np.flatnonzero(near), width)
            for at in range(0, len(i), 1 << 18):
                self.add(r, lo + i[at : at + (1 << 18)], j[at : at + (1 << 18)])


def knn(queries: DataFrame, references: DataFrame, key: str, vector: str, k: int, metric: str = "euclidean", exclude_self: bool = True, block: int = BLOCK, within: str | None = None, apart: str | None = None, core: bool = False) -> DataFrame:
    """``key, rank, neighbor, dist``: the k nearest references of every query, ties to the smaller key. ``metric``:
    euclidean or cosine (1 - cosine; a zero vector is at distance 1 from all). ``within``: only rows of the same value of
    this column are neighbours (by its hash); ``apart``: only rows of other values. ``core``: the first component is a
    distance that the row is no nearer than to any other (mutual reachability)."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    by = within or apart
    group = F.xxhash64(F.col(by).cast("string")) if by else F.lit(0).cast("long")
    left, asking = _blocks(queries.withColumn("__s", group), key, vector, block, "__s")
    right, asked = _blocks(references.withColumn("__s", group), key, vector, block, "__s")
    cosine = metric == "cosine"

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cell by cell: its reference blocks come first and are held, then its query blocks, one at a time."""
        for known, row in met_in_cells(batches, lambda row: Known(row, cosine, core)):
            found = Nearest(Known(row, cosine, core), k, exclude_self, bool(within), bool(apart))
            for r in known:
                found.meet(r)
            i, j = np.nonzero(np.isfinite(found.d))
            yield pa.RecordBatch.from_arrays([pa.array(found.q.names[i]), pa.array(found.n[i, j]), pa.array(found.d[i, j])], ["q", "neighbor", "dist"])

    # a grid of cells, a task each: a block of references goes to one column of it, a block of queries to one row
    rows, columns = _sides(asking, asked)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("i") * columns + F.col("j")).cast("int").alias("cell")
    met = right.select(upto(rows).alias("i"), F.pmod("b", F.lit(columns)).alias("j"), "k", "x", "s").select(cell, F.lit(0).alias("side"), "k", "x", "s")
    ask = left.select(F.pmod("b", F.lit(rows)).alias("i"), upto(columns).alias("j"), "k", "x", "s").select(cell, F.lit(1).alias("side"), "k", "x", "s")
    cells = met.unionByName(ask).repartitionById(rows * columns, F.col("cell")).sortWithinPartitions("cell", "side")
    found = cells.mapInArrow(best, "q long, neighbor long, dist double")
    order = Window.partitionBy("q").orderBy("dist", "neighbor")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("q").alias(key), "rank", "neighbor", "dist")


def met_in_cells(batches: Iterable[pa.RecordBatch], ready: Callable[[tuple], object]) -> Iterator[tuple[list, tuple]]:
    """``held, row`` of each row of side 1, with the rows of side 0 of its cell, made ready; rows are sorted by cell and
    side. One row is taken out of a batch at a time."""
    cell, held = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            here, side, *row = (column[at].as_py() for column in batch.columns)
            if here != cell:
                cell, held = here, []
            if side == 0:
                held.append(ready(row))
            elif held:
                yield held, row


def _sides(asking: int, asked: int) -> tuple[int, int]:
    """Rows and columns of a grid for so many blocks of queries and references: no cell has more than ``HELD`` of
    references, and few columns send few blocks of queries around."""
    rows = min(asking, WAYS)
    return rows, max(math.ceil(asked / HELD), min(asked, math.ceil(WAYS / rows)))


def mean_distance(neighbours: DataFrame, key: str) -> DataFrame:
    return neighbours.groupBy(key).agg(F.avg("dist").alias("score"))


def min_max(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Every dimension scaled to [0, 1] over all rows; constant ones are 0. Two passes; the bounds are a row a
    dimension."""
    rows = df.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("x"))
    bounds = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    table = bounds.agg(F.sort_array(F.collect_list(F.struct("dim", "lo", "hi"))).alias("b"))
    scaled = F.zip_with("x", "b", lambda v, b: F.when(b["hi"] > b["lo"], (v - b["lo"]) / (b["hi"] - b["lo"])).otherwise(F.lit(0.0)))
    return rows.crossJoin(F.broadcast(table)).select(key, scaled.alias("x"))


def kth_distance(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``key, radius``: the distance to the k-th nearest other row."""
    return knn(df, df, key, vector, k).filter(F.col("rank") == k).select(key, F.col("dist").alias("radius"))


def coverage_adaptive(radii: DataFrame, key: str, percent: float = 0.01) -> DataFrame:
    """The sparsest share of the rows: the ceil(percent * n) largest radii, ties to the smaller key."""
    radii = radii.checkpoint()
    most = math.ceil(percent * radii.count())
    return numbered(radii, "radius", key, "__n", descending=True).filter(F.col("__n") <= most).drop("__n")


def ball_radius(n: int, k: int, dims: int) -> float:
    """Radius of a ball that holds k of n uniform points of the unit cube (by log-gamma: no overflow)."""
    return math.exp((math.lgamma(dims / 2 + 1) + math.log(k / n)) / dims) / math.sqrt(math.pi)


def coverage(df: DataFrame, key: str, vector: str, method: str = "adaptive", percent: float = 0.01, num_observations: int = 50) -> tuple[DataFrame | None, str]:
    """Uncovered rows and the method that applied, or None and why it was skipped."""
    n = df.count()
    if n <= num_observations:
        return None, f"needs more than {num_observations} rows, has {n}"
    radii = kth_distance(df, key, vector, num_observations)
    if method == "naive":
        dims = df.select(F.max(F.size(vector))).first()[0]
        try:
            math.gamma(dims / 2 + 1)
        except OverflowError:
            return coverage_adaptive(radii, key, percent), "adaptive (naive overflowed)"
        return radii.filter(F.col("radius") > ball_radius(n, num_observations, dims)), "naive"
    return coverage_adaptive(radii, key, percent), "adaptive"


def dispersion(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, n, dispersion``: the mean distance of a class's vectors to its centroid. Sums by class and dimension are
    partial aggregates: no class is gathered."""
    rows = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("l"), F.col(vector).cast("array<double>").alias("x"))
    centres = rows.select("l", F.posexplode("x").alias("dim", "v")).groupBy("l", "dim").agg(F.avg("v").alias("c")).groupBy("l").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "c"))), lambda s: s["c"]).alias("c"))
    d = F.sqrt(F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    return rows.join(centres, "l").groupBy(F.col("l").alias(label)).agg(F.count("*").alias("n"), F.avg(d).alias("dispersion"))


#: Classes whose Gram matrices a task holds at once.
GRAM_CLASSES = 64


def class_profile(df: DataFrame, key: str, label: str, vector: str, min_samples: int = 20, isotropy_min: int | None = None, factor: float = 0.5) -> DataFrame:
    """Per class: n, dispersion and isotropy relative to the typical (median assessable) class, near-duplicate fraction
    (nearest neighbour of the class nearer than ``factor`` times the class's median), and whether it is assessable.

    Isotropy is the participation ratio of the covariance's eigenvalues, from sums of products that workers add up.
    """
    base = dispersion(df, label, vector)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, sums and Gram matrices of classes: a product of matrices for each class of a batch. No more than
        ``GRAM_CLASSES`` are held at once; the rest is summed up behind the shuffle."""
        held: dict = {}

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1].tolist() for h in held.values()]), pa.array([h[2].ravel().tolist() for h in held.values()])], ["l", "n", "s", "q"])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order = np.argsort(codes.indices.to_numpy(), kind="stable")
            ends = np.cumsum(np.bincount(codes.indices.to_numpy(), minlength=len(codes.dictionary)))
            for l, rows in zip(codes.dictionary.to_pylist(), np.split(x[order], ends[:-1])):
                n, s, q = held.get(l, (0, 0.0, 0.0))
                held[l] = n + len(rows), s + rows.sum(0), q + rows.T @ rows
                if len(held) > GRAM_CLASSES:
                    yield given()
                    held.clear()
        if held:
            yield given()

    def ratio(table: pa.Table) -> pa.Table:
        n = sum(table["n"].to_pylist())
        s, q = (np.sum([np.array(v) for v in table[c].to_pylist()], axis=0) for c in ("s", "q"))
        values = np.maximum(np.linalg.eigvalsh(q.reshape(len(s), len(s)) / n - np.outer(s / n, s / n)), 0)
        whole = n > max(len(s), isotropy_min or 0)
        return pa.table({"l": pa.array([table["l"][0].as_py()], pa.string()), "directions": pa.array([float(values.sum() ** 2 / (values**2).sum()) if whole and values.any() else None], pa.float64())})

    rows = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    spread = rows.select(F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(moments, "l string, n long, s array<double>, q array<double>").groupBy("l").applyInArrow(ratio, "l string, directions double")
    near = knn(rows, rows, key, vector, 1, within=label)  # neighbours are those of the class
    dist = near.join(rows.select(key, F.col(label).cast("string").alias("l")), key).select("l", "dist").checkpoint()
    typical = exact_quantiles(dist, "l", "dist", [0.5]).select("l", F.col("q")[0].alias("typical"))
    close = dist.join(typical, "l").groupBy("l").agg(F.avg((F.col("dist") < factor * F.col("typical")).cast("double")).alias("near_duplicate_fraction"))
    rows = base.withColumn("l", F.col(label).cast("string")).join(spread, "l", "left").join(close, "l", "left").withColumn("assessable", F.col("n") >= min_samples)
    usual = rows.filter("assessable").agg(F.percentile("dispersion", F.lit(0.5)).alias("ud"), F.percentile("directions", F.lit(0.5)).alias("ui"))
    return rows.crossJoin(F.broadcast(usual)).select(label, "n", (F.col("dispersion") / F.col("ud")).alias("dispersion"), (F.col("directions") / F.col("ui")).alias("isotropy"), F.coalesce("near_duplicate_fraction", F.lit(0.0)).alias("near_duplicate_fraction"), "assessable").orderBy("dispersion")


def completeness(df: DataFrame, vector: str) -> float:
    """Effective rank of the vectors over their dimension: exp of the entropy of the covariance's eigenvalues."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    rows = MLUtils.convertVectorColumnsFromML(df.filter(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v")), "v")
    cov = RowMatrix(rows).computeCovariance().toArray()
    q = np.maximum(np.linalg.eigvalsh(cov), 0)
    q = q[q > 0] / q.sum()
    return float(np.exp(-(q * np.log(q)).sum()) / len(cov)) if len(q) else 0.0


def ood_knn(test: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 10, metric: str = "cosine", percentile: float = 95.0) -> DataFrame:
    """``key, score, threshold, is_ood``: mean distance to the k nearest references, against a percentile of the
    references' own scores."""
    own = mean_distance(knn(reference, reference, key, vector, k, metric), key)
    limit = quantile(own.checkpoint(), "score", [percentile / 100]).select(F.col("q")[0].alias("threshold"))
    scores = mean_distance(knn(test, reference, key, vector, k, metric, exclude_self=False), key)
    return scores.crossJoin(F.broadcast(limit)).withColumn("is_ood", F.col("score") > F.col("threshold"))


def ood_summary(scores: DataFrame) -> DataFrame:
    """Counts, percent, the fitted threshold and the largest score that is not out of distribution."""
    inside = F.max(F.when(~F.col("is_ood"), F.col("score")))
    return scores.agg(F.count(F.when(F.col("is_ood"), 1)).alias("ood_count"), F.count("*").alias("total_count"), F.round(100.0 * F.avg(F.col("is_ood").cast("double")), 2).alias("ood_percentage"), F.round(F.coalesce(inside, F.min("score")), 6).alias("threshold_score"), F.round(F.max("threshold"), 6).alias("fitted_threshold"))


def ood_consensus(detectors: dict[str, DataFrame], key: str) -> DataFrame:
    """Over detectors: mean of score / threshold (those with a positive one), in any, in all, and in one only."""
    rows = None
    for name, scores in detectors.items():
        part = scores.select(key, F.lit(name).alias("detector"), F.when(F.col("threshold") > 0, F.col("score") / F.col("threshold")).alias("norm"), "is_ood")
        rows = part if rows is None else rows.union(part)
    hits = F.count(F.when(F.col("is_ood"), 1))
    return rows.groupBy(key).agg(F.round(F.avg("norm"), 6).alias("consensus"), (hits > 0).alias("any_ood"), (hits == len(detectors)).alias("mutual"), ((hits > 0) & (hits < len(detectors))).alias("unique"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """``bin, lo, hi, n``: equal widths, the last bin closed; numeric bounds."""
    bounds = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("a")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    return df.crossJoin(F.broadcast(bounds)).filter(F.col(value).isNotNull()).groupBy(at.alias("bin"), "a", "b").agg(F.count("*").alias("n")).select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "n")


def prioritize(scores: DataFrame, key: str, order: str = "hard_first", policy: str = "difficulty", bins: int = 50, label: str | None = None) -> DataFrame:
    """``key, score, position`` (from 1). difficulty: by score; stratified: in turn from equally filled score bins;
    class_balanced: in turn from the classes."""
    sign = F.col("score").desc() if order == "hard_first" else F.col("score").asc()
    hard = order == "hard_first"
    scores = scores.checkpoint()
    if policy == "difficulty":
        return numbered(scores, "score", key, "position", hard)
    if policy == "stratified":
        # each bin is a run of the order: a row's turn is its place in the bin
        n = scores.count()
        at = numbered(scores, "score", key, "__at", hard)
        first = lambda g: F.ceil(g * n / bins)
        dealt = at.withColumn("g", F.floor((F.col("__at") - 1) * bins / n)).withColumn("turn", (F.col("__at") - 1 - first(F.col("g"))).cast("long"))
        # before it: all earlier turns, and the bins before in its own; a bin of m rows has min(m, turn) in earlier turns
        sizes = [math.ceil((g + 1) * n / bins) - math.ceil(g * n / bins) for g in range(bins)]
        turns = F.array(*map(F.lit, sizes))
        earlier = F.aggregate(turns, F.lit(0).cast("long"), lambda t, m: t + F.least(m, F.col("turn")))
        own = F.size(F.filter(F.slice(turns, F.lit(1), F.col("g").cast("int")), lambda m: m > F.col("turn")))
        return dealt.withColumn("position", (earlier + own + 1).cast("int")).drop("g", "turn", "__at")
    if policy == "class_balanced" and label:
        group = F.col(label)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    dealt = scores.withColumn("g", group)
    dealt = dealt.withColumn("turn", (F.row_number().over(Window.partitionBy("g").orderBy(sign, key)) - 1).cast("long"))
    return renumbered(dealt.withColumn("position", F.col("turn")), "position", then=("g", key), width=1 << 10).withColumn("position", F.col("position") + 1).drop("g", "turn")


def fnn_divergence(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Henze-Penrose divergence of two samples from their joint 1-nearest-neighbour graph: 1 - C (m + n) / (2 m n) at
    least 0, C: edges between the samples. ``key`` is unique over both."""
    both = a.select(key, vector, F.lit(0).alias("side")).union(b.select(key, vector, F.lit(1).alias("side")))
    side = both.select(key, "side")
    edges = knn(both, both, key, vector, 1).join(side, key).join(side.select(F.col(key).alias("neighbor"), F.col("side").alias("other")), "neighbor")
    sizes = both.agg(F.sum("side").alias("n"), (F.count("*") - F.sum("side")).alias("m"))
    crossing = edges.agg(F.count(F.when(F.col("side") != F.col("other"), 1)).alias("crossing"))
    return crossing.crossJoin(F.broadcast(sizes)).select(F.round(F.greatest(F.lit(0.0), 1 - F.col("crossing") * (F.col("m") + F.col("n")) / (2.0 * F.col("m") * F.col("n"))), 6).alias("divergence"), "crossing")


def meetings(blocks: DataFrame, n: int, *columns: str) -> DataFrame:
    """Every two of ``n`` blocks in one cell of a triangle (``cell, side, b`` and the columns; for ``met_pairs``): blocks are
    dealt into parts, every two parts are a cell, a task each, that holds one and takes the blocks of the other one at a
    time. A block moves once for each part, not for each block."""
    parts = max(min(n, WAYS), math.ceil(n / HELD))
    dealt = blocks.withColumn("p", F.pmod("b", F.lit(parts))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    low, high = F.least("p", "o"), F.greatest("p", "o")
    cell = (high * (high + 1) / 2 + low).cast("int")
    # a part is held where it is the lower one; in its own cell it is also the one that comes
    sides = F.explode(F.when(F.col("p") < F.col("o"), F.array(F.lit(0))).when(F.col("p") > F.col("o"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    met = dealt.select(cell.alias("cell"), sides.alias("side"), "b", *columns)
    return met.repartitionById(parts * (parts + 1) // 2, F.col("cell")).sortWithinPartitions("cell", "side", "b")


def met_pairs(batches: Iterable[pa.RecordBatch], ready: Callable[[tuple], tuple]) -> Iterator[tuple[tuple, tuple]]:
    """Every two blocks that ``meetings`` brought together, made ready (a tuple that the number begins), once; each meets
    itself. A part that meets itself meets the blocks before."""
    for held, row in met_in_cells(batches, ready):
        own = any(h[0] == row[0] for h in held)
        other = ready(row)
        for h in held:
            if not own or h[0] <= other[0]:
                yield h, other


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x @ y.T
    d *= -2
    d += (x * x).sum(1)[:, None]
    d += (y * y).sum(1)[None, :]
    return np.maximum(d, 0, out=d)


def _tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a minimum spanning tree (Prim) of a matrix of distances, which is overwritten."""
    n = len(d)
    near, parent, done = d[0].copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    done[0], near[0] = True, np.inf
    ends = np.zeros(n - 1, np.int64)
    for step in range(n - 1):
        at = int(near.argmin())
        ends[step], done[at] = at, True
        row = d[at]
        row[done] = np.inf
        near[at] = np.inf
        better = row < near
        near[better], parent[better] = row[better], at
    return parent[ends], ends


#: Edges and components that the driver holds at once to join them; more are joined by Spark.
DRIVER_EDGES = 100_000
#: Neighbours of each row that a spanning tree starts from.
NEAR = 10


def _contracted(edges: DataFrame, sure: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One Boruvka round: the least edge of every component (``c``) of ``sure`` that has one no longer than its ``low``;
    the edges left between the components joined by them; and ``c, p``, the new component of each that changes.
    edges: a, b (components), d, ka, kb."""
    e = F.struct("d", "ka", "kb", "a", "b")
    least = edges.select(F.col("a").alias("c"), e.alias("e")).union(edges.select(F.col("b").alias("c"), e.alias("e"))).groupBy("c").agg(F.min("e").alias("e")).join(sure, "c").filter("e.d <= low").select("c", "e.*").checkpoint()
    if least.count() <= DRIVER_EDGES:
        parents = _held_together(least)
        return least.select("ka", "kb", "d").distinct(), _moved(edges, parents), parents
    other = F.when(F.col("c") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    to = least.select("c", other.alias("p"))
    back = to.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    # edges are in a strict order, so that cycles are of two: the smaller of both is the root, as is one without an edge
    ends = to.select(F.col("p").alias("c")).distinct().join(to, "c", "left_anti").select("c", F.col("c").alias("p"))
    parents = to.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")).union(ends).checkpoint()
    while True:
        jumped = parents.join(parents.select(F.col("c").alias("p"), F.col("p").alias("g")), "p").select("c", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")).checkpoint()
        parents = jumped.select("c", "p")
        if jumped.filter("moved").isEmpty():
            break
    return least.select("ka", "kb", "d").distinct(), _moved(edges, parents), parents


def _held_together(least: DataFrame) -> DataFrame:
    """``c, p``: the components that edges (``a, b``) join, by one of each."""
    e = least.select("a", "b").toArrow()
    names, at = np.unique(np.concatenate([e["a"].to_numpy(), e["b"].to_numpy()]), return_inverse=True)
    root = list(range(len(names)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for u, v in zip(at[: len(at) // 2].tolist(), at[len(at) // 2 :].tolist()):
        root[find(u)] = find(v)
    return least.sparkSession.createDataFrame(pa.table({"c": names, "p": names[np.array([find(v) for v in range(len(names))], np.int64)]}))


def _moved(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The least edge between any two of the new components."""
    for end in ("a", "b"):
        edges = edges.join(parents.select(F.col("c").alias(end), "p"), end, "left").withColumn(end, F.coalesce("p", end)).drop("p")
    return edges.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("d", "ka", "kb")).alias("e")).select("a", "b", "e.*").checkpoint()


def joined(a: np.ndarray, b: np.ndarray, order: np.ndarray, d: np.ndarray, size: np.ndarray, low: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Boruvka rounds among components 0 to n: the edges used, and the root of each component. A component takes its least
    edge if that is no longer than its ``low``, below which there may be unknown ones; the largest need not take any."""
    n, used, root = len(size), [], list(range(len(size)))
    a, b, live = a[order], b[order], order

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    at = np.arange(n)
    while True:
        a, b = at[a], at[b]
        apart = a != b
        a, b, live = a[apart], b[apart], live[apart]
        total, least, best = np.bincount(at, size, n), np.full(n, np.inf), np.full(n, len(live))
        np.minimum.at(least, at, low)
        np.minimum.at(best, a, np.arange(len(live)))
        np.minimum.at(best, b, np.arange(len(live)))
        some = np.flatnonzero(best < len(live))
        some = some[(d[live[best[some]]] <= least[some]) & (some != total.argmax())]
        if not len(some):
            return used, at
        for e in np.unique(best[some]).tolist():
            u, v = find(int(a[e])), find(int(b[e]))
            if u != v:
                root[v] = u
                used.append(int(live[e]))
        at = np.array([find(v) for v in range(n)])[at]


def spanning_tree(df: DataFrame, key: str, vector: str, block: int = BLOCK, core: str | None = None) -> DataFrame:
    """``a, b, d``: a Euclidean minimum spanning tree of any number of vectors and its lengths; keys are unique, a < b.
    ``core``: a column of distances that edges of a row are no shorter than (the larger of both ends: mutual reachability).

    Equal vectors hang on the smallest key among them. The ``NEAR`` nearest of every distinct row are edges to start
    from, and no unknown edge of the row is shorter than the last of them. So the least known edge of a component is its
    least one if no row of it has a nearer end of its list: Boruvka rounds take these, by Spark until the driver can hold
    the rest. Where a list ends too early, its row is given the nearest ones outside its component, by another search; the
    largest component never needs any.
    """
    # the core distance travels as a component in front of the others
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: v + F.lit(0.0))
    x = F.concat(F.array(F.col(core).cast("double") if core else F.lit(0.0)), x)
    rows = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), x.alias("x")).checkpoint()
    firsts = rows.groupBy("x").agg(F.min("k").alias("k")).checkpoint()
    copies = rows.join(firsts.select("x", F.col("k").alias("a")), "x").filter("k <> a").select("a", F.col("k").alias("b"), F.col("x")[0].alias("d"))
    blocks, n = _blocks(firsts, "k", "x", block)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in zip(*(batch.column(c).to_pylist() for c in range(2))):
                k, x = np.frombuffer(k, np.int64), np.frombuffer(x, np.float64)
                x = x.reshape(len(k), -1)
                if len(k) > 1:
                    least, x = x[:, 0] ** 2, x[:, 1:]
                    d = squared_distances(x, x)
                    np.maximum(d, least[:, None], out=d)
                    np.maximum(d, least[None, :], out=d)
                    a, b = _tree(d)
                    d = np.maximum(((x[a] - x[b]) ** 2).sum(1), np.maximum(least[a], least[b]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[a], k[b])), pa.array(np.maximum(k[a], k[b])), pa.array(np.sqrt(d))], ["a", "b", "d"])

    if n == 1:
        return copies.union(blocks.select("k", "x").mapInArrow(whole, "a long, b long, d double").checkpoint())

    def listed(near: DataFrame) -> DataFrame:
        """``k, bound``: no unknown edge is shorter; a list that is not full is all there is."""
        return near.groupBy("k").agg(F.when(F.count("*") == NEAR, F.max("dist")).otherwise(F.lit(math.inf)).alias("bound"))

    pairs = lambda near: near.groupBy(F.least("k", "neighbor").alias("ka"), F.greatest("k", "neighbor").alias("kb")).agg(F.min("dist").alias("d"))
    near = knn(firsts, firsts, "k", "x", NEAR, block=block, core=True).checkpoint()
    points = listed(near).withColumn("c", F.col("k")).checkpoint()
    edges = pairs(near).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "d", "ka", "kb").checkpoint()
    tree, spark = copies, df.sparkSession
    while True:
        comps = points.groupBy("c").agg(F.count("*").alias("n"), F.min("bound").alias("low")).checkpoint()
        left = comps.count()
        if left <= 1:
            return tree
        if edges.count() + left > DRIVER_EDGES:
            largest = comps.orderBy(F.desc("n"), "c").first()["c"]
            chosen, edges, parents = _contracted(edges, comps.filter(F.col("c") != largest).select("c", "low"))
        else:
            e, c = edges.toArrow(), comps.toArrow().sort_by("c")
            names, size, low = (c[x].to_numpy() for x in ("c", "n", "low"))
            a, b = (np.searchsorted(names, e[x].to_numpy()) for x in ("a", "b"))
            ka, kb, d = (e[x].to_numpy() for x in ("ka", "kb", "d"))
            used, root = joined(a, b, np.lexsort((kb, ka, d)), d, size, low)
            chosen = spark.createDataFrame(pa.table({"ka": pa.array(ka[used], pa.int64()), "kb": pa.array(kb[used], pa.int64()), "d": pa.array(d[used], pa.float64())}))
            parents = spark.createDataFrame(pa.table({"c": names, "p": names[root]}))
            if len(np.unique(root)) == 1:
                return tree.union(chosen.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "d"))
            edges = _moved(edges, parents) if used else edges
            largest = names[root][np.bincount(root, size)[root].argmax()].item()
        if not chosen.isEmpty():
            tree = tree.union(chosen.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "d"))
            points = points.join(parents, "c", "left").select("k", "bound", F.coalesce("p", "c").alias("c")).checkpoint()
            continue
        # rows with a list that ends before the least known edge of their component
        least = edges.select(F.col("a").alias("c"), "d").union(edges.select(F.col("b").alias("c"), "d")).groupBy("c").agg(F.min("d").alias("d"))
        short = points.filter(F.col("c") != largest).join(least, "c", "left").filter(F.col("d").isNull() | (F.col("bound") < F.col("d"))).select("k")
        placed = firsts.join(points.select("k", "c"), "k").checkpoint()
        near = knn(placed.join(short, "k", "left_semi"), placed, "k", "x", NEAR, block=block, apart="c", core=True).checkpoint()
        if near.isEmpty():
            return tree
        found = pairs(near)
        for end in ("a", "b"):
            found = found.join(points.select(F.col("k").alias(f"k{end}"), F.col("c").alias(end)), f"k{end}")
        edges = _moved(edges.unionByName(found), points.select("c", F.col("c").alias("p")).limit(0))
        points = points.join(listed(near).withColumnRenamed("bound", "further"), "k", "left").select("k", F.coalesce("further", "bound").alias("bound"), "c").checkpoint()


def mst_divergence(a: DataFrame, b: DataFrame, key: str, vector: str, block: int = BLOCK) -> float:
    """The same from a Euclidean minimum spanning tree of all rows."""
    both = a.select(key, vector, F.lit(0).alias("side")).union(b.select(key, vector, F.lit(1).alias("side"))).filter(F.col(vector).isNotNull() & F.col(key).isNotNull())
    side = both.select(F.col(key).cast("long").alias("a"), F.col("side").alias("sa"))
    edges = spanning_tree(both, key, vector, block).drop("d").join(side, "a").join(side.toDF("b", "sb"), "b")
    crossing = edges.filter("sa <> sb").count()
    n, m = both.agg(F.sum("side"), F.count("*") - F.sum("side")).first()
    return max(0.0, 1 - crossing * (m + n) / (2 * m * n))


def kmeans_scores(pool: DataFrame, reference: DataFrame, key: str, vector: str, clusters: int, method: str = "kmeans_distance", seed: int = 1) -> DataFrame:
    """``key, score`` of the pool by clusters of the reference. kmeans_distance: distance to the nearest centre;
    kmeans_complexity: that, over the mean distance of the centre's own members."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = lambda df: df.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("x")).withColumn("features", array_to_vector("x"))
    model = KMeans(k=clusters, seed=seed).fit(ready(reference))
    centres = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in model.clusterCenters()))
    d = F.sqrt(F.aggregate(F.zip_with("x", centres[F.col("prediction")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    scored = model.transform(ready(pool)).select(key, "prediction", d.alias("score"))
    if method == "kmeans_distance":
        return scored.select(key, "score")
    if method != "kmeans_complexity":
        raise ValueError(f"unknown method {method!r}")
    usual = model.transform(ready(reference)).select("prediction", d.alias("d")).groupBy("prediction").agg(F.avg("d").alias("usual"))
    return scored.join(F.broadcast(usual), "prediction", "left").select(key, (F.col("score") / F.greatest(F.coalesce("usual", F.lit(0.0)), F.lit(1e-12))).alias("score"))
