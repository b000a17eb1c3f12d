"""Approximate nearest neighbours by largest inner product: NN-descent, then greedy graph search.

Vectors get one more component that makes all norms equal, so that on the graph the largest inner product is the nearest
neighbour; queries are compared by the plain inner product of the original vectors, in double precision.

1. Nodes close in space (by the sides of random hyperplanes that they are on) are at home together, about ``HOME`` of
   them, and a home is one row of every table here. A first graph comes from runs of several other such orders.
2. NN-descent: in each round every node's neighbours, and a sample of the nodes that have it as a neighbour, meet in Spark
   joins and are compared with each other; pairs that met before are skipped; each node keeps its best. Homes ask each
   other for what their nodes need, once, and are told of better neighbours; these messages are what is joined. The
   rounds end when less than ``SETTLED_SHARE`` of the entries are new.
3. Greedy search: queries start from their place in the graph, home by home; each follows the best nodes not yet
   followed, what any of a home's queries comes to is compared with all of them, and the search ends when the best
   ``BEAM`` that each query has seen have all been followed, however many rounds that takes.

Equal vectors are one node, which its rows' smallest keys stand for in the answers, so copies of any number crowd nothing
out. Every row is indexed. A node takes part in at most neighbours + REVERSE comparisons' groups a round, whatever its
fame; recall is measured against brute force in the tests. Vectors of different lengths are compared as if padded with
zeros. The graph holds as many neighbours a node as are asked for, ``NEIGHBOURS`` at least, so no answer is short.

Defined results: vectors null, empty, zero or holding null or non-finite components take no part, nor do rows with a
null key; rows with equal keys are one vector; equal scores are ordered by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import discard, give_back, mix64, settled
from plumbline.llm.vectors import usable

NEIGHBOURS, REVERSE = 24, 16
TABLES, LEAF = 6, 512
SETTLED_SHARE = 0.02
BEAM, FOLLOWED = 160, 48
#: Candidates that a node gets from one group.
OFFERS = 4
#: Nodes at home together, about; a node's number is its home's and, in so many bits, its place there.
HOME, PLACE_BITS = 4096, 16
#: A home's number is its leaf's and, in so many bits, which part of a large leaf it is.
PART_BITS = 20
SEED = 11


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows as a table of this schema (long, int and binary columns)."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    columns = list(zip(*rows)) if rows else [[]] * len(schema.split(", "))
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip((x.split() for x in schema.split(", ")), columns)})


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _by_home(ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Homes, and where in ``ids`` their nodes are."""
    homes = ids >> PLACE_BITS
    order = np.argsort(homes, kind="stable")
    cuts = [*np.flatnonzero(np.append(True, homes[order][1:] != homes[order][:-1])).tolist(), len(ids)] if len(ids) else [0]
    return [(int(homes[order[a]]), order[a:b]) for a, b in zip(cuts, cuts[1:])]


def _ranked(group: np.ndarray, most: int) -> np.ndarray:
    """Of sorted values, which are among the first ``most`` of their run."""
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group)))) < most


def _runs(batches: Iterable[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.Table]:
    """Runs of rows equal in their first ``keys`` columns, of ``most`` rows at most."""
    held: list[pa.RecordBatch] = []
    last, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            name = tuple(names[:, lo].tolist())
            if name != last and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            last = name
            while lo < hi:
                take = min(hi - lo, most - size)
                held.append(batch.slice(lo, take))
                lo, size = lo + take, size + take
                if size == most:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def index_vectors(classes: DataFrame) -> tuple[DataFrame, int, int, type]:
    """``home, names, x, w`` (packed): the classes at home together, their vectors of one norm (float16) and the
    originals; how wide x is, how many there are, and what w holds. classes: node, v."""
    n, width, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))))).first()
    kind = np.float32 if dict(classes.dtypes)["v"] == "array<float>" else np.float64
    bits = max(0, math.ceil(math.log2(max(1, n / HOME))))
    planes = np.random.default_rng(SEED - 1).normal(size=(width + 1, bits)).astype(np.float32)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = np.zeros((batch.num_rows, width), kind)
            for i, v in enumerate(batch.column(1).to_pylist()):
                w[i, : len(v)] = v
            x = np.zeros((batch.num_rows, width + 1))
            x[:, :-1] = w.astype(np.float64) / longest
            x[:, -1] = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_leaves(x, planes), pa.int64()), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), pa.array([r.tobytes() for r in w], pa.binary())], ["name", "leaf", "x", "w"])

    packed = settled(classes.select("node", "v").mapInArrow(pack, "name long, leaf long, x binary, w binary"))
    parts = packed.groupBy("leaf").agg(F.ceil(F.count("*") / HOME).cast("long").alias("parts")).withColumnRenamed("leaf", "l")
    home = F.shiftleft("leaf", PART_BITS).bitwiseOR(F.pmod(F.xxhash64("name"), F.col("parts")))

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("name")
        return _table("home long, names binary, x binary, w binary", [(rows["home"][0].as_py(), rows["name"].to_numpy().tobytes(), b"".join(rows["x"].to_pylist()), b"".join(rows["w"].to_pylist()))])

    at_home = packed.join(parts, F.col("leaf") == F.col("l")).select(home.alias("home"), "name", "x", "w").groupBy("home")
    index = settled(at_home.applyInArrow(gather, "home long, names binary, x binary, w binary"))
    discard(packed)
    return index, width + 1, n, kind


def _leaves(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """On which sides of the planes vectors are, as numbers."""
    return ((x @ planes > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64))).astype(np.int64) if planes.shape[1] else np.zeros(len(x), np.int64)


OFFER_SCHEMA = "home long, node binary, ids binary, sims binary"
LIST_SCHEMA = "home long, ids binary, sims binary, fresh binary, n_fresh long"


def _offers(node: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.Table:
    """Neighbours proposed to nodes, as a message to each home."""
    return _table(OFFER_SCHEMA, [(home, node[at].tobytes(), ids[at].tobytes(), sims[at].astype(np.float32).tobytes()) for home, at in _by_home(node)])


def merged(lists: DataFrame, offers: DataFrame, neighbours: int) -> DataFrame:
    """The lists of each home (its nodes in order, ``neighbours`` entries each, -1 where there is none, best first) with
    what it was offered. ``lists`` has ``m``, the nodes of a home, where there are no lists yet."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(LIST_SCHEMA, [])
        home, m = left["home"][0].as_py(), left["m"][0].as_py()
        nodes = (home << PLACE_BITS) + np.arange(m)
        ids, sims = (np.frombuffer(left[c][0].as_py(), t) for c, t in (("ids", np.int64), ("sims", np.float32)))
        held = ids >= 0
        node = np.concatenate([np.repeat(nodes, len(ids) // m)[held], _joined(right["node"], np.int64)])
        fresh = np.repeat([0, 1], [held.sum(), len(node) - held.sum()]).astype(np.uint8)
        ids, sims = np.concatenate([ids[held], _joined(right["ids"], np.int64)]), np.concatenate([sims[held], _joined(right["sims"], np.float32)])
        order = np.lexsort((fresh, ids, node))  # of an entry met twice the older stays
        node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
        once = np.append(True, (node[1:] != node[:-1]) | (ids[1:] != ids[:-1]))[: len(node)] & (node != ids)
        order = np.flatnonzero(once)[np.lexsort((ids[once], -sims[once], node[once]))]
        order = order[_ranked(node[order], neighbours)]
        node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
        at = node - nodes[0], np.arange(len(node)) - np.searchsorted(node, node)
        out = np.full((m, neighbours), -1), np.full((m, neighbours), -9, np.float32), np.zeros((m, neighbours), np.uint8)
        out[0][at], out[1][at], out[2][at] = ids, sims, fresh
        give_back()
        return _table(LIST_SCHEMA, [(home, *(x.tobytes() for x in out), int(fresh.sum()))])

    return lists.select("home", "m", "ids", "sims").groupBy("home").cogroup(offers.groupBy("home")).applyInArrow(run, LIST_SCHEMA)


def _with_sizes(lists: DataFrame, neighbours: int) -> DataFrame:
    return lists.withColumn("m", (F.octet_length("ids") / (8 * neighbours)).cast("int"))


def first_graph(index: DataFrame, width: int, n: int, neighbours: int) -> DataFrame:
    """The best of the runs that each node is in, in as many orders as there are tables. A run goes on over a leaf's
    end, so that a vector alone in its leaf has neighbours too."""
    bits = max(0, math.ceil(math.log2(max(1, n / (LEAF // 2)))))
    planes = np.random.default_rng(SEED).normal(size=(TABLES, width, bits)).astype(np.float32)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = np.frombuffer(raw, np.float16).reshape(-1, width)
                x, rows = held.astype(np.float32), pa.array([r.tobytes() for r in held], pa.binary())
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int64()), pa.array(_leaves(x, planes[t])), pa.array((home << PLACE_BITS) + np.arange(len(x))), rows], ["t", "leaf", "node", "x"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1, LEAF):
            names = run["node"].to_numpy()
            x = _joined(run["x"], np.float16).reshape(-1, width).astype(np.float32)
            if len(names) < 2:
                continue
            sims = x @ x.T
            np.fill_diagonal(sims, -9)
            k = min(neighbours, len(names) - 1)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            yield from _offers(np.repeat(names, k), names[best].ravel(), np.take_along_axis(sims, best, 1).ravel()).to_batches()

    # ranges, not hashes: a leaf that holds very many is spread over several tasks
    dealt = index.select("home", "x").mapInArrow(deal, "t long, leaf long, node long, x binary").withColumn("h", F.xxhash64("node"))
    ordered = dealt.repartitionByRange(max(1, TABLES * n // (16 * LEAF)), "t", "leaf", "h").sortWithinPartitions("t", "leaf", "h")
    none = index.select("home", (F.octet_length("names") / 8).cast("int").alias("m"), F.lit(b"").alias("ids"), F.lit(b"").alias("sims"))
    return merged(none, ordered.select("t", "node", "x").mapInArrow(search, OFFER_SCHEMA), neighbours)


MET_SCHEMA = "home long, sizes binary, met binary, fresh binary"


def meetings(lists: DataFrame, neighbours: int) -> DataFrame:
    """For each home, who meets at each of its nodes (``sizes`` of them, end to end in ``met``): its neighbours, and a
    sample by hash of the nodes that have it as one."""
    schema = "home long, a binary, b binary, fresh binary"

    def sample(a: np.ndarray, b: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((mix64(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)), a))
        order = order[_ranked(a[order], REVERSE)]
        return a[order], b[order], fresh[order]

    def back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, ids, fresh in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, fresh = np.frombuffer(ids, np.int64), np.frombuffer(fresh, np.uint8)
                held = np.flatnonzero(ids >= 0)
                a, b, fresh = sample(ids[held], (home << PLACE_BITS) + held // neighbours, fresh[held])
                yield from _table(schema, [(to, a[at].tobytes(), b[at].tobytes(), fresh[at].tobytes()) for to, at in _by_home(a)]).to_batches()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(MET_SCHEMA, [])
        home, ids, fresh = left["home"][0].as_py(), np.frombuffer(left["ids"][0].as_py(), np.int64), np.frombuffer(left["fresh"][0].as_py(), np.uint8)
        held = np.flatnonzero(ids >= 0)
        a, b, f = sample(*(_joined(right[c], t) for c, t in (("a", np.int64), ("b", np.int64), ("fresh", np.uint8))))
        a, b, f = np.concatenate([(home << PLACE_BITS) + held // neighbours, a]), np.concatenate([ids[held], b]), np.concatenate([fresh[held], f])
        order = np.lexsort((1 - f, b, a))
        a, b, f = a[order], b[order], f[order]
        once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        sizes = np.bincount(a[once] - (home << PLACE_BITS), minlength=len(ids) // neighbours)
        return _table(MET_SCHEMA, [(home, sizes.tobytes(), b[once].tobytes(), f[once].tobytes())])

    told = lists.select("home", "ids", "fresh").mapInArrow(back, schema)
    return lists.select("home", "ids", "fresh").groupBy("home").cogroup(told.groupBy("home")).applyInArrow(run, MET_SCHEMA)


ASKED_SCHEMA = "owner long, home long, ids binary"


def _asked(home: int, ids: np.ndarray) -> list[tuple]:
    """What a home asks others for, as a message to each."""
    return [(owner, home, ids[at].tobytes()) for owner, at in _by_home(ids)]


def answered(asked: DataFrame, owners: DataFrame, columns: dict[str, int]) -> DataFrame:
    """``home, ids`` with the asked nodes' values of ``columns``, which take so many bytes a node in the owners' rows."""
    schema = "home long, ids binary, " + ", ".join(f"{c} binary" for c in columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(schema, [])
        held = [np.frombuffer(right[c][0].as_py(), np.uint8).reshape(-1, size) for c, size in columns.items()]
        at = [np.frombuffer(x, np.int64) & ((1 << PLACE_BITS) - 1) for x in left["ids"].to_pylist()]
        return _table(schema, [(home, ids, *(h[i].tobytes() for h in held)) for home, ids, i in zip(left["home"].to_pylist(), left["ids"].to_pylist(), at)])

    return asked.groupBy("owner").cogroup(owners.select("home", *columns).groupBy("home")).applyInArrow(run, schema)


def descend(lists: DataFrame, index: DataFrame, width: int, neighbours: int) -> DataFrame:
    """One round: lists improved by comparing the neighbours of every node with each other; those before are deleted."""
    met = settled(meetings(lists, neighbours))
    most = neighbours + REVERSE

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _table(ASKED_SCHEMA, _asked(home, np.unique(np.frombuffer(ids, np.int64)))).to_batches()

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst = [np.frombuffer(x, np.float32).reshape(-1, neighbours)[:, -1].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(worst, pa.binary())], ["h", "bound"])

    owners = index.select("home", "x").join(lists.select("home", "sims").mapInArrow(bounds, "h long, bound binary"), F.col("home") == F.col("h"))
    sent = answered(met.select("home", "met").mapInArrow(ask, ASKED_SCHEMA), owners, {"x": 2 * width, "bound": 4})

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(OFFER_SCHEMA, [])
        names = _joined(right["ids"], np.int64)
        order = np.argsort(names)
        vectors, bound = _joined(right["x"], np.float16).reshape(-1, width)[order], _joined(right["bound"], np.float32)[order]
        names = names[order]
        sizes = np.frombuffer(left["sizes"][0].as_py(), np.int64)
        who_all, fresh_all = np.searchsorted(names, np.frombuffer(left["met"][0].as_py(), np.int64)), np.frombuffer(left["fresh"][0].as_py(), bool)
        ends = np.cumsum(sizes)
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(sizes), 256):
            part = sizes[lo : lo + 256]
            a, b = ends[lo] - part[0], ends[lo + len(part) - 1]
            at = np.repeat(np.arange(len(part)), part), np.arange(a, b) - np.repeat(ends[lo : lo + 256] - part, part)
            who, fresh = np.full((len(part), most), -1), np.zeros((len(part), most), bool)
            who[at], fresh[at] = who_all[a:b], fresh_all[a:b]
            busy = fresh.any(1)
            who, fresh = who[busy], fresh[busy]
            if not len(who):
                continue
            x = vectors[who].astype(np.float32)
            sims = x @ x.transpose(0, 2, 1)
            use = (who[:, :, None] >= 0) & (who[:, None, :] >= 0) & (fresh[:, :, None] | fresh[:, None, :]) & (sims > bound[who][:, :, None])
            use[:, np.arange(most), np.arange(most)] = False
            sims = np.where(use, sims, -9)
            best = np.argpartition(-sims, OFFERS - 1, axis=2)[:, :, :OFFERS]
            value = np.take_along_axis(sims, best, 2)
            g, i, o = np.nonzero(value > -9)
            out.append((who[g, i], who[g, best[g, i, o]], value[g, i, o]))
        if not out:
            return _table(OFFER_SCHEMA, [])
        node, ids, sims = (np.concatenate(z) for z in zip(*out))
        order = np.lexsort((ids, node))  # a pair met at several nodes is one offer
        node, ids, sims = node[order], ids[order], sims[order]
        once = np.append(True, (node[1:] != node[:-1]) | (ids[1:] != ids[:-1]))
        give_back()
        return _offers(names[node[once]], names[ids[once]], sims[once])

    found = met.groupBy("home").cogroup(sent.groupBy("home")).applyInArrow(compare, OFFER_SCHEMA)
    better = settled(merged(_with_sizes(lists, neighbours), found, neighbours))
    discard(met)
    discard(lists)
    return better


def neighbour_graph(index: DataFrame, width: int, n: int, neighbours: int) -> DataFrame:
    """NN-descent from the first graph. Lists only get better, so the rounds end."""
    lists = settled(first_graph(index, width, n, neighbours))
    while True:
        lists = descend(lists, index, width, neighbours)
        if (lists.agg(F.sum("n_fresh")).first()[0] or 0) <= SETTLED_SHARE * n * neighbours:
            return lists


STATE_SCHEMA = "home long, q binary, v binary, ids binary, scores binary, followed binary, seen binary, open long"


def search(asking: DataFrame, index: DataFrame, lists: DataFrame, width: int, neighbours: int, kind: type, most: int) -> DataFrame:
    """``query_id, id, score``: greedy search from each query's own place. asking: home, q (packed nodes)."""
    near = settled(meetings(lists, neighbours).select("home", "sizes", "met"))
    beam = max(BEAM, 4 * most)
    size = width * np.dtype(kind).itemsize

    def state_of(row: dict) -> pa.Table:
        return _table(STATE_SCHEMA, [tuple(row[c.split()[0]] for c in STATE_SCHEMA.split(", "))])

    def begin(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(STATE_SCHEMA, [])
        q, w = np.frombuffer(left["q"][0].as_py(), np.int64), np.frombuffer(right["w"][0].as_py(), np.uint8).reshape(-1, size)
        row = {"home": left["home"][0].as_py(), "q": q.tobytes(), "v": w[q & ((1 << PLACE_BITS) - 1)].tobytes(), "open": len(q), "seen": b""}
        row |= {"ids": np.full((len(q), beam), -1).tobytes(), "scores": np.full((len(q), beam), -np.inf).tobytes(), "followed": bytes(len(q) * beam)}
        return state_of(row)

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        q = np.frombuffer(row["q"], np.int64)
        shaped = lambda c, t: np.frombuffer(row[c], t).reshape(len(q), beam)
        return q, shaped("ids", np.int64), shaped("scores", np.float64), shaped("followed", bool), np.frombuffer(row["seen"], np.int64)

    def turn(ids: np.ndarray, followed: np.ndarray) -> np.ndarray:
        """Which entries of the beams (best first) are followed now."""
        waiting = (ids >= 0) & ~followed
        return waiting & (np.cumsum(waiting, axis=1) <= FOLLOWED)

    def front(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, ids, _, followed, seen = opened(row)
                a = np.unique(ids[turn(ids, followed)]) if len(seen) else np.sort(q)
                yield from _table(ASKED_SCHEMA, _asked(row["home"], a)).to_batches()

    def neighbours_of(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table("home long, ids binary", [])
        sizes, met = np.frombuffer(right["sizes"][0].as_py(), np.int64), np.frombuffer(right["met"][0].as_py(), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out = []
        for home, ids in zip(left["home"].to_pylist(), left["ids"].to_pylist()):
            wanted = np.zeros(len(sizes), bool)
            wanted[np.frombuffer(ids, np.int64) & ((1 << PLACE_BITS) - 1)] = True
            out.append((home, np.unique(np.concatenate([met[wanted[owner]], np.frombuffer(ids, np.int64)])).tobytes()))
        return _table("home long, ids binary", out)

    def unseen(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(ASKED_SCHEMA, [])
        return _table(ASKED_SCHEMA, _asked(left["home"][0].as_py(), np.setdiff1d(_joined(right["ids"], np.int64), np.frombuffer(left["seen"][0].as_py(), np.int64))))

    def advance(left: pa.Table, right: pa.Table) -> pa.Table:
        """Marks what ``front`` has handed out and adds the candidates to the state of every query of the home."""
        if not left.num_rows:
            return _table(STATE_SCHEMA, [])
        row = left.to_pylist()[0]
        q, ids, scores, followed, seen = opened(row)
        followed = followed | turn(ids, followed)
        v, b = np.frombuffer(row["v"], kind).reshape(len(q), width).astype(np.float64), _joined(right["ids"], np.int64)
        w = _joined(right["w"], kind).reshape(-1, width)
        for lo in range(0, len(b), 4096):
            names = b[lo : lo + 4096]
            new = v @ w[lo : lo + 4096].astype(np.float64).T
            ids, scores = np.concatenate([ids, np.broadcast_to(names, new.shape)], 1), np.concatenate([scores, new], 1)
            followed = np.concatenate([followed, np.broadcast_to(names, new.shape) == q[:, None]], 1)  # its own place is where it began
            best = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
            ids, scores, followed = (np.take_along_axis(z, best, 1) for z in (ids, scores, followed))
            order = np.lexsort((ids, -scores), axis=1)
            ids, scores, followed = (np.take_along_axis(z, order, 1) for z in (ids, scores, followed))
        give_back()
        row |= {"ids": ids.tobytes(), "scores": scores.tobytes(), "followed": followed.tobytes(), "seen": np.union1d(seen, b).tobytes(), "open": int(turn(ids, followed).sum())}
        return state_of(row)

    state = settled(asking.groupBy("home").cogroup(index.select("home", "w").groupBy("home")).applyInArrow(begin, STATE_SCHEMA))
    while state.agg(F.sum("open")).first()[0]:
        asked = state.filter("open > 0").mapInArrow(front, ASKED_SCHEMA)
        met = asked.groupBy("owner").cogroup(near.groupBy("home")).applyInArrow(neighbours_of, "home long, ids binary")
        new = state.select("home", "seen").groupBy("home").cogroup(met.groupBy("home")).applyInArrow(unseen, ASKED_SCHEMA)
        found = answered(new, index, {"w": size})
        before, state = state, settled(state.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(advance, STATE_SCHEMA))
        discard(before)

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, ids, scores, _, _ = opened(row)
                i, j = np.nonzero((ids >= 0) & (ids != q[:, None]))
                few = _ranked(i, most)
                i, j = i[few], j[few]
                yield pa.RecordBatch.from_arrays([pa.array(q[i], pa.int64()), pa.array(ids[i, j], pa.int64()), pa.array(scores[i, j], pa.float64())], ["query_id", "id", "score"])

    return state.mapInArrow(answer, "query_id long, id long, score double")


def node_names(index: DataFrame) -> DataFrame:
    """``node, name``: the class that each node stands for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names = np.frombuffer(names, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((home << PLACE_BITS) + np.arange(len(names))), pa.array(names)], ["node", "name"])

    return index.select("home", "names").mapInArrow(run, "node long, name long")


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", most: int = 20) -> DataFrame:
    """``query_id, rank, key, score``: for each row where ``queries`` holds, the ``most`` others with the largest inner
    products that the search finds."""
    rows = df.select(F.col(key).cast("long").alias("node"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("node").isNotNull() & usable("v"))
    rows = settled(rows.groupBy("node").agg(F.min(F.struct("v", "asks")).alias("r")).select("node", "r.v", "r.asks"))
    classes = settled(rows.groupBy("v").agg(F.min("node").alias("node"), F.max("asks").alias("asks")).select("node", "v", "asks"))
    index, width, n, kind = index_vectors(classes)
    neighbours = max(NEIGHBOURS, most)
    lists = neighbour_graph(index, width, n, neighbours)
    names = settled(node_names(index))

    def gather(table: pa.Table) -> pa.Table:
        return _table("home long, q binary", [(table["home"][0].as_py(), np.sort(table["node"].to_numpy()).tobytes())])

    asked = names.join(classes.filter("asks").select(F.col("node").alias("name")), "name", "left_semi").select(F.shiftright("node", PLACE_BITS).alias("home"), "node")
    asked = asked.groupBy("home").applyInArrow(gather, "home long, q binary")
    found = search(asked, index, lists, width - 1, neighbours, kind, most)
    found = found.join(names.select(F.col("node").alias("query_id"), F.col("name").alias("q")), "query_id").join(names.select(F.col("node").alias("id"), F.col("name").alias("i")), "id")
    found = found.select(F.col("q").alias("query_id"), F.col("i").alias("id"), "score")

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = [float((np.array(v, np.float64) ** 2).sum()) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), pa.array(squares, pa.float64())], ["query_id", "id", "score"])

    found = found.union(classes.filter("asks").select("node", "v").mapInArrow(own, "query_id long, id long, score double"))
    # a class stands for its members: of each, the smallest keys that can be among the best, and one for the query itself
    members = rows.join(classes.select("v", F.col("node").alias("c")), "v").select("c", "node", "asks")
    first = settled(members.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("node"))).filter(F.col("n") <= most + 1).select("c", "node"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    spread = found.join(first, F.col("id") == F.col("c")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most + 1)
    answers = spread.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "node", "score"))).alias("best"))
    asking = members.filter("asks").select("c", F.col("node").alias("q"))
    others = F.slice(F.filter("best", lambda x: x["node"] != F.col("q")), 1, most)
    out = asking.join(answers, F.col("c") == F.col("query_id")).select("q", F.posexplode(others).alias("at", "x"))
    return out.select(F.col("q").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.node").alias(key), F.col("x.score").alias("score"))
