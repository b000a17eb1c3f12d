"""Near-duplicate embeddings: an epsilon grid order join on leading principal dimensions.

1. Equal vectors of a label form a class; only classes are compared, weighted by their size.
2. Unit vectors are rotated to principal axes (fitted on a bounded sample: any rotation gives the same result). A cosine
   of ``least`` is a distance of eps; the grid's cells are eps wide on the leading axes.
3. The classes are sorted by label and cell and cut into blocks of consecutive ones, which are ordered by splits within.
   Two blocks meet only if their boxes (on the leading axes, and of what is left of each vector beside them) are within
   eps; they meet by the cells their boxes touch, never all with all.
4. Two blocks are joined recursively: both sequence intervals are halved, parts whose boxes are over eps apart are
   skipped, small parts are compared by a product of matrices in double precision. What is skipped depends on the
   vectors: clustered ones skip nearly all, evenly spread ones of many dimensions have nothing that is provably distant.

From two blocks come sums of linked rows, one a class, and star-shaped edges, fewer than there are classes, not pairs.
Blocks are bounded, so are tasks; links are exact.

Defined results: rows with a null label, or a vector that is null, empty, zero or holds null or non-finite components,
are linked with nothing, nor are vectors of different lengths; a row with a null key takes no part and has no component;
rows with equal keys are vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import settled
from plumbline.llm.graph import components
from plumbline.llm.vectors import matrix, sampled, usable

AXES = 16
#: Axes whose cells order the classes.
GRID = 8
#: Vectors the axes are fitted on, classes in a block, and classes compared by one product.
SAMPLE, BLOCK, LEAF = 10_000, 512, 32
#: Added to squared distances before anything is skipped: more than rounding can take off.
SLACK = 1e-6


def principal_axes(x: np.ndarray, axes: int = AXES) -> np.ndarray:
    """Columns: the leading principal directions of some unit vectors."""
    if not len(x):
        return np.zeros((0, axes))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(np.cov(unit.T, bias=True).reshape(x.shape[1], x.shape[1]))
    return np.ascontiguousarray(vectors[:, ::-1][:, :axes])


def projected(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors on the axes, and how long the rest of each is: two are at least as far apart as these."""
    p = np.zeros((len(x), AXES + 1))
    p[:, : axes.shape[1]] = x @ axes
    p[:, AXES] = np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))
    return p


def split_order(p: np.ndarray) -> np.ndarray:
    """An order in which halves, quarters and so on of a run are close together: split at the median of the axis on
    which they spread most, again and again."""
    order, todo = np.arange(len(p)), [(0, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            continue
        part = p[order[a:b]]
        m = (b - a) // 2
        order[a:b] = order[a:b][np.argsort(part[:, np.argmax(np.ptp(part, axis=0))], kind="stable")]
        todo += [(a, a + m), (a + m, b)]
    return order


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Squared distance of the boxes around two runs of projected vectors."""
    gap = np.maximum(np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)), 0)
    return float(gap @ gap)


def interval_join(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places (in x, in y) of all pairs with a cosine of ``least`` or more, and how many pairs were compared; x, y: unit
    vectors; same: y is x, and each pair is wanted once."""
    reach = 2 - 2 * least + SLACK
    found: list[tuple[np.ndarray, np.ndarray]] = []
    compared = 0
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a + 1 or b <= a or d <= c or _apart(px[a:b], py[c:d]) > reach:
            continue
        if max(b - a, d - c) > LEAF:
            m, n = (a + b) // 2, (c + d) // 2
            todo += [(a, m, c, n), (a, m, n, d), (m, b, n, d), (m, b, c, n)]
            continue
        compared += (b - a) * (d - c)
        i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
        i, j = i + a, j + c
        if same:
            i, j = i[i < j], j[i < j]
        found.append((i, j))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), compared
    return *(np.concatenate(z) for z in zip(*found)), compared


def _forest(i: np.ndarray, j: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """Stars that connect what the pairs connect."""
    root = list(range(len(names)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    touched = np.unique(np.concatenate([i, j])).tolist()
    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b, key=lambda v: names[v])] = min(a, b, key=lambda v: names[v])
    return [(int(names[v]), int(names[find(v)])) for v in touched if find(v) != v]


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, report: dict | None = None) -> DataFrame:
    """``key, n_links, component_id, kept``: links are pairs of rows of one label with a cosine of ``least`` or more. A
    ``report`` is told how many pairs of different vectors of a label there are (``possible``) and how many were
    ``compared``: the rest was skipped as provably distant."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("x"), F.col(label).alias("l"))
    rows = rows.withColumn("part", usable("x") & F.col("l").isNotNull() & F.col("k").isNotNull())
    name = [F.when(F.col("part"), F.xxhash64(F.lit(seed), "x", F.size("x"))).alias(f"h{seed}") for seed in (1, 2)]
    rows = settled(rows.select("k", "l", "x", "part", *name))
    classes = rows.filter("part").groupBy("l", "h1", "h2").agg(F.min("k").alias("least"), F.count("*").alias("m"), F.first("x").alias("x"))
    # a class has a number of its own: rows of different labels may share a key
    classes = settled(classes.withColumn("c", F.monotonically_increasing_id()))
    axes = principal_axes(sampled(classes, "x", "c", SAMPLE))
    eps = math.sqrt(max(2 - 2 * least, 1e-12))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the projections; cells are their floor by eps."""
        for batch in batches:
            lists = batch.column(3).to_pylist()
            p = np.zeros((len(lists), AXES + 1))  # of another length than the axes: one cell
            for i, x in enumerate(lists):
                if len(x) == len(axes):
                    v = np.array(x, np.float64)
                    p[i] = projected((v / np.linalg.norm(v))[None], axes)[0]
            cells = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.tolist(), pa.list_(pa.float64())), *(pa.array(cells[:, a]) for a in range(GRID))], ["c", "m", "l", "x", "d", "p", *(f"g{a}" for a in range(GRID))])

    label_kind, vector_kind = dict(df.dtypes)[label], dict(df.dtypes)[vector]
    grid = [f"g{a}" for a in range(GRID)]
    placed = classes.select("c", "m", "l", "x", F.size("x").alias("d")).mapInArrow(place, f"c long, m long, l {label_kind}, x {vector_kind}, d int, p array<double>, {', '.join(g + ' int' for g in grid)}")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of consecutive classes of a label and length: what they hold, packed, and their boxes."""
        held: list[pa.RecordBatch] = []
        at, size = None, 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            p = matrix(table["p"])
            order = split_order(p)
            p, x, c = p[order], matrix(table["x"])[order], table["c"].to_numpy()[order]
            out = [pa.array([int(c.min())]), table["l"].combine_chunks()[:1], pa.array([at[1]], pa.int32()), pa.array([c.tobytes()]), pa.array([table["m"].to_numpy()[order].tobytes()]), pa.array([x.tobytes()]), pa.array([p.tobytes()]), pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()])]
            return pa.RecordBatch.from_arrays(out, ["b", "l", "d", "c", "m", "x", "p", "low", "high"])

        for batch in batches:
            labels, lengths = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            lo = 0
            for i in range(1, batch.num_rows + 1):
                if i == batch.num_rows or (labels[i], lengths[i]) != (labels[lo], lengths[lo]) or i - lo + (size if (labels[lo], lengths[lo]) == at else 0) >= BLOCK:
                    if at is not None and (labels[lo], lengths[lo]) != at and held:
                        yield block()
                        held, size = [], 0
                    at = (labels[lo], lengths[lo])
                    held.append(batch.slice(lo, i - lo))
                    size += i - lo
                    if size >= BLOCK:
                        yield block()
                        held, size = [], 0
                    lo = i
        if held:
            yield block()

    order = [F.col("l"), F.col("d"), *(F.col(g) for g in grid), F.col("c")]
    blocks = settled(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"b long, l {label_kind}, d int, c binary, m binary, x binary, p binary, low array<double>, high array<double>"))
    # boxes meet in the cells of the first two axes that they touch, widened by eps on one side
    # (of the first, on one side: either block may be the lower one)
    def cells(low: int, high: int) -> DataFrame:
        out = blocks.select("b", "l", "d", "low", "high", F.explode(F.sequence(F.floor(F.col("low")[0] / eps), F.floor(F.col("high")[0] / eps) + high)).alias("z0"))
        return out.select("*", F.explode(F.sequence(F.floor(F.col("low")[1] / eps) - low, F.floor(F.col("high")[1] / eps) + high)).alias("z1"))

    left, right = (side.select("l", "d", "z0", "z1", *(F.col(c).alias(c + end) for c in ("b", "low", "high"))) for side, end in ((cells(0, 0), "1"), (cells(1, 1), "2")))
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(AXES)), F.lit(0.0), lambda t, a: t + F.pow(F.greatest(F.get("low1", a) - F.get("high2", a), F.get("low2", a) - F.get("high1", a), F.lit(0.0)), F.lit(2.0)))
    met = left.join(right, ["l", "d", "z0", "z1"]).filter(gap <= eps * eps + SLACK).select(F.least("b1", "b2").alias("i"), F.greatest("b1", "b2").alias("j")).distinct()

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, d, *held = (batch.column(n)[r].as_py() for n in range(11))
                c1, m1, c2, m2 = (np.frombuffer(held[n], np.int64) for n in (0, 1, 4, 5))
                x1, x2 = (np.frombuffer(held[n], np.float64).reshape(-1, d) for n in (2, 6))
                p1, p2 = (np.frombuffer(held[n], np.float64).reshape(-1, AXES + 1) for n in (3, 7))
                x1, x2 = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (x1, x2))
                a, b, compared = interval_join(x1, x2, p1, p2, least, i == j)
                if report is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([compared], pa.int64()), pa.array([None], pa.int64())], ["a", "links", "b"])
                if not len(a):
                    continue
                n1, n2 = np.bincount(a, m2[b], len(c1)).astype(np.int64), np.bincount(b, m1[a], len(c2)).astype(np.int64)
                names = np.concatenate([c1, c2]) if i != j else c1
                edges = _forest(a, b + (len(c1) if i != j else 0), names)
                who, links = np.concatenate([c1[n1 > 0], c2[n2 > 0]]), np.concatenate([n1[n1 > 0], n2[n2 > 0]])
                ea, eb = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array([*who.tolist(), *ea]), pa.array([*links.tolist(), *([0] * len(ea))]), pa.array([None] * len(who) + list(eb), pa.int64())], ["a", "links", "b"])

    held = blocks.select("b", "d", "c", "m", "x", "p")
    first = held.select(F.col("b").alias("i"), "d", *(F.col(n).alias(n + "1") for n in "cmxp"))
    second = held.select(F.col("b").alias("j"), *(F.col(n).alias(n + "2") for n in "cmxp"))
    pairs = met.join(first, "i").join(second, "j").select("i", "j", "d", "c1", "m1", "x1", "p1", "c2", "m2", "x2", "p2")
    found = settled(pairs.mapInArrow(compare, "a long, links long, b long"))
    if report is not None:
        report["possible"] = classes.groupBy("l", F.size("x")).count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0))).first()[0]
        report["compared"] = found.filter("a = -1").agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]
    links = found.filter("b is null and a >= 0").groupBy("a").agg(F.sum("links").alias("links"))
    linked = settled(components(found.filter("b is not null").select("a", "b")))
    smallest = linked.join(classes.select("c", "least"), F.col("node") == F.col("c")).groupBy("root").agg(F.min("least").alias("smallest"))
    linked = linked.join(smallest, "root").select("node", "smallest")
    known = classes.select("l", "h1", "h2", "c", "m", "least").join(links, F.col("c") == F.col("a"), "left").join(linked, F.col("c") == F.col("node"), "left")
    known = known.select(F.col("l").alias("kl"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("root"))
    out = rows.drop("x").join(known, F.col("part") & (F.col("l") == F.col("kl")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce(F.col("root"), F.col("k"))
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
