"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

1. Rows with the same shingle set form a class; only classes go on, so exact copies cost one row each.
2. A class's set is hashed once and dealt into bins; a bin keeps its minimum, an empty one takes that of a full bin
   chosen by a fixed random sequence. Bands of bins name the buckets.
3. In a bucket, members whose sketches (a byte a bin) agree in enough bins are joined by stars: a bucket of n members
   has n - 1 edges at most. The components are families.
4. A family's full sets are compared exactly, by a product of membership matrices; again only stars leave. Their
   components are the result.

Buckets and families of any size are compared by the same rule, large ones in parts: with one member first, then those
that it leaves apart with all. No task holds more than two parts, no pairs within a group are written, and nothing is
dropped. What the method itself may miss: a pair at the threshold stays out of all 32 buckets with a probability of
0.5904 ** 32, about 5e-8 (a pair of similarity 0.9: 1e-15).

Defined results: texts without words have an empty set and are linked with nothing; rows with a null key count in their
class but their component is null; repeated rows are in one class and, having one key, are all kept or all not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, give_back, mix64, settled, shingle_set, slices
from plumbline.llm.graph import components

BINS, ROWS = 128, 4
#: A pair of similarity 0.8 agrees in fewer bins with a probability below 1e-17.
SKETCH_AGREES = 56
#: Members of a bucket that are compared by their sketches; of a block whose full sets are, and its shingles.
BUCKET_MEMBERS, BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 400, 500_000
#: Columns of a membership matrix multiplied at once.
MATRIX_COLUMNS = 8192
SEED = np.uint64(0x5851F42D4C957F2D)
DONORS = np.random.Generator(np.random.PCG64(7)).integers(0, BINS, size=(BINS, 2048))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of the bins of a non-empty set, densified."""
    hashed = np.sort(mix64(shingles ^ SEED))
    place = (hashed >> np.uint64(64 - 7)).astype(np.int64)
    first = np.append(True, place[1:] != place[:-1])
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[place[first]], full[place[first]] = hashed[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        out[empty] = out[DONORS[empty, full[DONORS[empty]].argmax(1)]]
    return out


def bands(minima: np.ndarray) -> np.ndarray:
    """A bucket name for each band of bins."""
    rows = minima.reshape(-1, ROWS)
    out = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def shingle_classes(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``key, n, c, sketch, bands`` of every row: the size of its set and, unless it is empty, the name of its class."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, c, sketches, names = [], [], [], []
            for t in part.column(1).to_pylist():
                found = shingle_set(t, words)
                n.append(len(found))
                minima = signature(found) if len(found) else None
                c.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                sketches.append((mix64(minima) & np.uint64(255)).astype(np.uint8).tobytes() if len(found) else None)
                names.append(bands(minima).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(sketches, pa.binary()), pa.array(names, pa.list_(pa.int64()))], ["k", "n", "c", "sketch", "bands"])

    return arrow_map(df.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, n long, c long, sketch binary, bands array<long>")


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows equal in their first ``keys`` columns (long), across sorted batches; a run is handed out whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            name = tuple(columns[:, lo].tolist())
            if name != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = name
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def _stars(links: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """The components of a symmetric matrix of links, each as a star around its smallest name."""
    left, out = np.ones(len(names), bool), []
    for i in np.argsort(names, kind="stable").tolist():
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            near = links[front].any(0) & left
            left &= ~near
            front = np.flatnonzero(near).tolist()
            out.extend((int(names[j]), int(names[i])) for j in front)
    return out


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def group_links(rows: DataFrame, most: int, weight: int, linked: Callable[[list, list], np.ndarray]) -> DataFrame:
    """Edges ``a, b`` that connect in each group what ``linked`` connects. ``rows``: group, c, first, n, data; ``linked``
    takes two lists of data and says which pairs are linked.

    A group of no more than ``most`` members and ``weight`` in their sizes is compared by one task. A larger one is cut
    into parts of so many. First all members are compared with one, the pivot (that with the smallest ``first``, the
    likely source of the others): those linked with it are connected, whatever links they have among each other. Only the
    rest meets all parts. So a family around one text costs its members, not their pairs, and no link is lost.
    """
    parts = F.greatest(F.ceil(F.col("m") / most), F.ceil(F.col("size") / weight)).cast("long")
    sizes = lambda df: df.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("size")).filter("m > 1" if df is rows else "m > 0").select(F.col("group").alias("g"), parts.alias("parts"))
    known = rows.join(sizes(rows), F.col("group") == F.col("g")).drop("g")
    one = known.filter("parts = 1").select("group", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("side"), "c", "data")
    large = settled(known.filter("parts > 1").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts"))))

    def compare(told: bool) -> Callable:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges: list[tuple] = []
            for (group, i, j), table in _groups(batches, 3):
                names, side, data = table["c"].to_numpy(), table["side"].to_numpy(), table["data"].to_pylist()
                a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
                links = np.zeros((len(names), len(names)), bool)
                if len(a) and len(b):
                    links[np.ix_(a, b)] = linked([data[x] for x in a], [data[x] for x in b])
                edges += _stars(links | links.T, names)
                if told:  # who isn't linked with the pivot
                    edges += [(int(names[x]), None) for x in b[~links[a[0], b]]]
                if len(edges) > 50_000:
                    yield _edge_batch(edges)
                    edges = []
            give_back()
            yield _edge_batch(edges)

        return run

    meet = lambda df, told=False: arrow_map(df.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j"), compare(told), "a long, b long")
    found = meet(one)
    if not large.isEmpty():
        # the pivot is -1, and meets every part; it is the smallest name of its star, so its edges lead to it
        pivots = large.groupBy("group").agg(F.min(F.struct(F.col("first").isNull().alias("last"), "first", "c", "data", "parts")).alias("p"))
        pivots = pivots.select("group", F.lit(-1).cast("long").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.parts") - 1)).alias("j"), F.lit(-1).cast("long").alias("side"), "p.c", "p.data")
        around = settled(meet(pivots.union(large.select("group", F.lit(-1).cast("long").alias("i"), F.col("part").alias("j"), F.col("part").alias("side"), "c", "data")), True))
        found = found.union(around.filter("b is not null"))
        apart = around.filter("b is null").select(F.col("a").alias("x")).distinct()
        # a member that one group's pivot leaves apart may be in other groups: it meets their parts too, which adds no link
        rest = large.join(apart, F.col("c") == F.col("x"), "left_semi")
        counts = sizes(rest).withColumnRenamed("parts", "rests")
        rest = rest.join(counts, F.col("group") == F.col("g")).drop("g").withColumn("i", F.pmod(F.xxhash64("c", "group"), F.col("rests")))
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        left = rest.select("group", F.col("i"), upto("parts").alias("j"), "c", "data").select("group", "i", (F.col("j") + F.lit(1 << 40)).alias("j"), F.col("i").alias("side"), "c", "data")
        right = large.join(counts, F.col("group") == F.col("g")).select("group", upto("rests").alias("i"), (F.col("part") + F.lit(1 << 40)).alias("j"), (F.col("part") + F.lit(1 << 40)).alias("side"), "c", "data")
        found = found.union(meet(left.union(right)))
    return found


def sketches_agree(least: int, similarity: float) -> Callable[[list, list], np.ndarray]:
    """Whether sketches (each after the size of its set, 8 bytes) agree in so many bins, and the sizes allow it."""

    def opened(data: list) -> tuple[np.ndarray, np.ndarray]:
        held = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), 8 + BINS)
        return np.ascontiguousarray(held[:, :8]).view(">i8")[:, 0].astype(np.int64), held[:, 8:]

    def linked(left: list, right: list) -> np.ndarray:
        (m, x), (n, y) = opened(left), opened(right)
        out = np.stack([(y == row).sum(1) >= least for row in x])
        return out & (np.minimum.outer(m, n) >= similarity * np.maximum.outer(m, n) - 1e-9)

    return linked


def bucket_edges(classes: DataFrame, similarity: float) -> DataFrame:
    """Edges of the families: what connects the members of each bucket that their sketches and sizes leave possible."""
    entries = classes.select("c", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket")
    packed = classes.select(F.col("c").alias("x"), F.col("k").alias("first"), F.concat(size_bytes(), "sketch").alias("data"))
    members = entries.join(shared, "bucket").join(packed, F.col("c") == F.col("x")).select(F.col("bucket").alias("group"), "c", "first", F.lit(1).alias("n"), "data")
    return group_links(members, BUCKET_MEMBERS, BUCKET_MEMBERS, sketches_agree(SKETCH_AGREES, similarity)).distinct()


def size_bytes() -> Column:
    """``n`` in 8 bytes, the highest first."""
    return F.to_binary(F.lpad(F.hex("n"), 16, "0"), F.lit("hex"))


def sets_linked(percent: float) -> Callable[[list, list], np.ndarray]:
    """Whether sets (sorted shingles, as bytes) have this Jaccard similarity in percent."""

    def linked(left: list, right: list) -> np.ndarray:
        a, b = ([np.frombuffer(x, np.uint64) for x in side] for side in (left, right))
        m, n = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        common = intersections(a, b).astype(np.int64)
        return 100 * common >= percent * (m[:, None] + n[None, :] - common)

    return linked


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, by a product of membership matrices over the shingles met twice."""
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(flat, kind="stable")
    fresh = np.append(True, flat[order][1:] != flat[order][:-1])
    column = np.empty(len(flat), np.int64)
    column[order] = np.cumsum(fresh) - 1
    often = np.bincount(column) > 1
    number = np.where(often, np.cumsum(often) - 1, -1)[column]
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(often.sum())
    for lo in range(0, total, MATRIX_COLUMNS):
        a, b = np.searchsorted(number, [lo, lo + MATRIX_COLUMNS])
        held = np.zeros((len(left) + len(right), min(MATRIX_COLUMNS, total - lo)), np.float32)
        held[row[a:b], number[a:b] - lo] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``key, n_shingles, component_id, kept``: links are pairs of rows whose sets of lower-cased ``words``-word
    shingles have this Jaccard similarity or more; ``component_id`` is the smallest key reachable."""
    percent = 100 * similarity
    kind = dict(df.dtypes)[key]
    rows = settled(shingle_classes(df, key, text, words))
    classes = rows.filter("c is not null").groupBy("c").agg(F.min(F.struct(F.col("k").isNull().alias("last"), "k", "n", "sketch", "bands")).alias("x")).select("c", "x.k", "x.n", "x.sketch", "x.bands")
    classes = settled(classes)
    families = settled(components(bucket_edges(classes, similarity)).select(F.col("node").alias("c"), F.col("root").alias("family")))
    members = families.join(classes.select("c", "k"), "c")

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
            names = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), *part.columns[2:]], ["c", "found", "data", "n", "group", "first"])

    texts = df.select(F.col(key).alias("dk"), F.col(text).alias("t")).join(members, F.col("dk").eqNullSafe(F.col("k"))).select("c", "t", F.col("family").alias("group"), F.col("k").alias("first"))
    sets = arrow_map(texts, shingles, f"c long, found long, data binary, n long, group long, first {kind}").filter("c = found").dropDuplicates(["group", "c"])
    linked = components(group_links(settled(sets.select("group", "c", "first", "n", "data")), BLOCK_MEMBERS, BLOCK_SHINGLES, sets_linked(percent)))
    smallest = linked.join(classes.select("c", "k"), F.col("node") == F.col("c")).groupBy("root").agg(F.min("k").alias("least"))
    labels = classes.select("c", "k").join(linked, F.col("c") == F.col("node"), "left").join(smallest, "root", "left").select(F.col("c").alias("label"), F.coalesce("least", "k").alias("component_id"))
    out = rows.select("k", "n", "c").join(labels, F.col("c") == F.col("label"), "left")
    component = F.when(F.col("k").isNull(), F.lit(None)).when(F.col("c").isNull(), F.col("k")).otherwise(F.col("component_id")).cast(kind)
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
