"""Repair of conversations: the cheapest edits that give a conversation the shape ``(system? (user assistant)+)?``.

Nodes of a graph are (rows done, state of the shape); arcs are edits with small integer costs: Keep 0, Insert an empty
message 2, Rerole to user or assistant 2, Delete 3; a truncated message that stays costs 1 more, blank and duplicate ones
must go. Dial's bucket queue gives every node's distance to the end; then the audit is walked along tight arcs, the
smallest letter first, which gives the least of all cheapest audits.

A conversation of any length is cut at the partitions of one global sort, into pieces. A piece's distances between its
states at both ends are a 4 x 4 matrix, its walks a map of four states; both compose, so only these travel between the
pieces of a conversation (as many as partitions at most), and every piece is walked where it lies. What alone passes
through one task is the hash over a conversation's whole text: SHA-256 has no other way; it is streamed, a piece at a time.

Rows are taken by turn (nulls first); those of one turn by role, then text (by 256 characters, then by digest). Defined
results: null roles and texts count as one space; a null key is a conversation like any other; rows marked as gone don't
count, but their conversation is there, if need be with nothing in it; repeated rows are duplicates; extra columns aren't
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, settled, text_bytes

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Text of a partition, and of a slice of pieces.
PARTITION_BYTES, SLICE_BYTES = 32 << 20, 4 << 20

# The shape: nothing yet, after system, after user, after assistant. Roles: system, user, assistant, any other.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
#: Where the only message that may be inserted leads to.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, INSERT, REROLE, DELETE, CUT = 0, 2, 2, 3, 1
FAR = 1 << 60
GOAL = (0, FAR, FAR, 0)
WHITE = " \t\n\x0b\x0c\r"


def edits(role: int, fault: int) -> list[list[tuple[str, int, int]]]:
    """From each state, what can be done with a message: (letter, cost, next state), by letter."""
    out = []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if fault not in (BLANK, DUPLICATE):
            more = CUT if fault == TRUNCATED else 0
            if STEP[q][role] is not None:
                arcs.append(("K", KEEP + more, STEP[q][role]))
            arcs.append(("R", REROLE + more, NEXT[q]))
        out.append(arcs)
    return out


#: Edits of each kind of message (role + 4 * fault), and the same arcs backwards: by the state they lead to, (state, cost).
EDITS = [edits(kind & 3, kind >> 2) for kind in range(16)]
BACK = [[[(p, cost) for p in range(4) for _, cost, to in arcs[p] if to == q] for q in range(4)] for arcs in EDITS]
INSERTED = [[p for p in range(4) if NEXT[p] == q] for q in range(4)]


def distances(kinds: bytes, right: tuple[int, ...]) -> list[int]:
    """The distance of each node (4 * rows done + state) to the end; ``right``: that of the states after the last row.

    Dial: a ring of buckets, one for each distance that can be open at a time."""
    n = len(kinds)
    dist = [FAR] * (4 * n + 4)
    known = [d for d in right if d < FAR]
    at = min(known)
    ring: list[list[int]] = [[] for _ in range(max(known) - at + DELETE + 1)]
    size, waiting = len(ring), len(known)
    for q, d in enumerate(right):
        if d < FAR:
            dist[4 * n + q] = d
            ring[d % size].append(4 * n + q)
    while waiting:
        bucket = ring[at % size]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != at:  # a shorter way was found since
                continue
            i, q = node >> 2, node & 3
            for p in INSERTED[q]:
                if at + INSERT < dist[4 * i + p]:
                    dist[4 * i + p] = at + INSERT
                    ring[(at + INSERT) % size].append(4 * i + p)
                    waiting += 1
            if i:
                for p, cost in BACK[kinds[i - 1]][q]:
                    if at + cost < dist[4 * i - 4 + p]:
                        dist[4 * i - 4 + p] = at + cost
                        ring[(at + cost) % size].append(4 * i - 4 + p)
                        waiting += 1
        at += 1
    return dist


def walk(kinds: bytes, dist: list[int], state: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """The least cheapest edits from ``state`` on, as (letter, row, state after it), and the state behind them. What is
    inserted after the last row of a piece belongs to the next piece, if there is one."""
    out, i, n = [], 0, len(kinds)
    while i < n or last:
        here = dist[4 * i + state]
        found = None
        arcs = EDITS[kinds[i]][state] if i < n else []
        if arcs and dist[4 * i + 4 + arcs[0][2]] + arcs[0][1] == here:
            found = arcs[0]
        elif dist[4 * i + NEXT[state]] + INSERT == here:
            found = ("I", INSERT, NEXT[state])
        else:
            found = next((a for a in arcs[1:] if dist[4 * i + 4 + a[2]] + a[1] == here), None)
        if found is None:
            break
        state = found[2]
        out.append((found[0], i, state))
        i += found[0] != "I"
    return out, state


def kinds_of(roles: list[str], faults: bytes | list[int]) -> bytes:
    return bytes("sua".find(r[:1]) % 4 + 4 * f if r else 3 + 4 * f for r, f in zip(roles, faults))


def is_blank(text: Column) -> Column:
    return F.translate(text, WHITE, "") == ""


def is_truncated(text: Column) -> Column:
    """Whether the last character that isn't white space ends no sentence."""
    return ~F.regexp_replace(text, r"[ \t\n\x0b\f\r]+\z", "").rlike(r"[.!?]\z")


# One row for the piece of a conversation in a partition. The first and last of a partition may go on in another one.
PIECE = "key {}, part int, run int, edge boolean, turns array<bigint>, roles array<string>, texts array<string>, faults binary"


def pieces_of(df: DataFrame, key: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """The conversations' messages, sorted over all partitions and packed, with faults but for duplicates in other pieces.

    ``turns``: the first, the last and the number of different turns, nulls left out."""
    space = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    there = F.lit(True) if gone is None else ~F.coalesce(df[gone], F.lit(False))
    rows = df.select(df[key].alias("key"), df[turn].cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), there.alias("there"))
    rows = rows.withColumn("fault", F.when(is_blank(F.col("text")), BLANK).when(is_truncated(F.col("text")), TRUNCATED).otherwise(0).cast("byte"))
    # equal rows are told apart by where they lie, so that any number of them can be dealt out
    rows = rows.withColumns({"head": F.substring("text", 1, 256), "tail": F.when(F.length("text") > 256, F.md5(F.col("text").cast("binary"))).otherwise(""), "salt": F.monotonically_increasing_id()})
    order = ["key", "turn", "role", "head", "tail", "salt"]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(rows) // PARTITION_BYTES))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", F.spark_partition_id().alias("part"), "turn", "role", "text", "there", "fault")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, size, count, arrow, current, part = [], 0, 0, None, None, 0

        def batch() -> pa.RecordBatch:
            names = ("key", "part", "run", "edge", "turns", "roles", "texts", "faults")
            kinds = (arrow, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*packed), kinds)], list(names))

        def close(last: bool) -> None:
            key, turns, roles, texts, faults, _ = current
            packed.append((key, part, count, last or count == 0, turns, roles, texts, bytes(faults)))

        for data in batches:
            arrow = data.column(0).type
            for key, part, turn, role, text, there, fault in zip(*(c.to_pylist() for c in data.columns)):
                if current is None or current[0] != key:
                    if current is not None:
                        close(False)
                        count += 1
                    if size > SLICE_BYTES:
                        yield batch()
                        packed.clear()
                        size = 0
                    current = (key, [], [], [], [], set())
                if not there:
                    continue
                _, turns, roles, texts, faults, seen = current
                if turn is not None:
                    if not turns:
                        turns[:] = [turn, turn, 1]
                    elif turns[1] != turn:
                        turns[1:] = [turn, turns[2] + 1]
                if fault != BLANK:
                    if (role, text) in seen:
                        fault = DUPLICATE
                    seen.add((role, text))
                roles.append(role)
                texts.append(text)
                faults.append(fault)
                size += len(text)
        if current is not None:
            close(True)
            yield batch()

    return settled(rows.mapInArrow(run, PIECE.format(kind)))


def later_duplicates(pieces: DataFrame) -> DataFrame:
    """``part, run, dups``: places in pieces of messages whose like stands in an earlier piece of their conversation."""
    rows = pieces.select("key", "part", "run", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "m"), "faults")
    rows = rows.filter(F.expr("substring(faults, i + 1, 1) <> X'01'"))
    name = F.sha2(F.concat(F.length("m.roles").cast("string"), F.lit(":"), "m.roles", "m.texts").cast("binary"), 256)
    rows = rows.select(F.coalesce(F.to_json(F.struct("key")), F.lit("")).alias("k"), "part", "run", "i", name.alias("name"))
    first = rows.groupBy("k", "name").agg(F.min("part").alias("first"))
    return rows.join(first, ["k", "name"]).filter("part > first").groupBy("part", "run").agg(F.collect_list("i").alias("dups"))


def corrected(faults: bytes, dups: list[int] | None) -> bytes:
    out = bytearray(faults)
    for i in dups if dups is not None else ():
        out[i] = DUPLICATE
    return bytes(out)


def matrix(kinds: bytes) -> list[int]:
    """Distances from each state before a piece to each state behind it, row by row."""
    columns = [distances(kinds, tuple(0 if q == to else FAR for q in range(4)))[:4] for to in range(4)]
    return [columns[to][q] for q in range(4) for to in range(4)]


def bounds_of(pieces: DataFrame) -> DataFrame:
    """Of conversations in several pieces, each piece's ``dups``, distances behind it (``right``), state before it
    (``entry``) and whether it is the ``last``. Pieces' matrices and maps of states are all that is grouped."""
    edges = pieces.filter("edge")
    several = edges.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"))
    some = edges.join(several, edges["key"].eqNullSafe(several["k"]), "left_semi")
    some = settled(some.join(later_duplicates(some), ["part", "run"], "left").select("key", "part", "run", "roles", "faults", "dups"))

    def each_matrix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [matrix(kinds_of(r, corrected(f, d))) for r, f, d in zip(*(b.column(c).to_pylist() for c in ("roles", "faults", "dups")))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("part"), b.column("run"), pa.array(found, pa.list_(pa.int64()))], ["key", "part", "run", "matrix"])

    kind = some.schema["key"].dataType.simpleString()

    def behind(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        right, out = np.array(distances(b"", GOAL)), []
        for m in reversed(group["matrix"].tolist()):
            out.append(right.tolist())
            right = (np.array(m).reshape(4, 4) + right).min(axis=1)
        return pd.DataFrame({"part": group["part"], "run": group["run"], "right": out[::-1], "last": [*[False] * (len(out) - 1), True]})

    rights = some.mapInArrow(each_matrix, f"key {kind}, part int, run int, matrix array<bigint>").groupBy("key").applyInPandas(behind, "part int, run int, right array<bigint>, last boolean")
    known = settled(some.join(rights, ["part", "run"]))

    def each_exit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for roles, faults, dups, right, last in zip(*(b.column(c).to_pylist() for c in ("roles", "faults", "dups", "right", "last"))):
                kinds = kinds_of(roles, corrected(faults, dups))
                dist = distances(kinds, tuple(right))
                found.append([walk(kinds, dist, q, last)[1] for q in range(4)])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("part"), b.column("run"), pa.array(found, pa.list_(pa.int32()))], ["key", "part", "run", "exits"])

    def entered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        state, out = START, []
        for exits in group["exits"]:
            out.append(state)
            state = int(exits[state])
        return pd.DataFrame({"part": group["part"], "run": group["run"], "entry": out})

    entries = known.mapInArrow(each_exit, f"key {kind}, part int, run int, exits array<int>").groupBy("key").applyInPandas(entered, "part int, run int, entry int")
    out = settled(known.join(entries, ["part", "run"]).select("part", "run", "dups", "right", "last", "entry"))
    discard(some)
    discard(known)
    return out


WALKED = "key {}, part int, turns array<bigint>, initials array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, roles array<string>, texts array<string>"
LEGAL = {"su", "ua", "au"}


def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of ``WALKED`` of a stream of pieces; those of conversations in one piece have no bounds."""
    names = ("key", "part", "turns", "roles", "texts", "faults", "dups", "right", "last", "entry")
    for b in batches:
        for key, part, turns, roles, texts, faults, dups, right, last, entry in zip(*(b.column(c).to_pylist() for c in names)):
            faults = corrected(faults, dups)
            kinds = kinds_of(roles, faults)
            dist = distances(kinds, GOAL if right is None else tuple(right))
            entry = START if entry is None else entry
            path, _ = walk(kinds, dist, entry, last is not False)
            initials = [r[:1] for r in roles]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            out_roles, out_texts = [], []
            for letter, i, state in path:
                if letter != "D":
                    out_roles.append(roles[i] if letter == "K" else NAMES[state])
                    out_texts.append("" if letter == "I" else texts[i])
            ends = [initials[0], initials[-1]] if initials else []
            yield key, part, turns, ends, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, dist[entry], "".join(p[0] for p in path), out_roles, out_texts


def summed(rows: Iterable[tuple]) -> Iterator[tuple]:
    """One row a conversation, of its pieces one after the other: what is next to what across pieces counts as well."""
    for _, group in groupby(rows, key=lambda r: (r[0] is None, r[0])):
        digest, audit, counts, cost, illegal = hashlib.sha256(), [], [0, 0, 0], None, 0
        span, before, started = [], None, False
        for key, _, turns, ends, blank, duplicate, truncated, wrong, left, letters, roles, texts in group:
            counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated))]
            cost = left if cost is None else cost
            illegal += wrong + bool(ends and before is not None and before + ends[0] not in LEGAL)
            before = ends[1] if ends else before
            if turns:
                span = [span[0], turns[1], span[2] + turns[2] - (span[1] == turns[0])] if span else list(turns)
            audit.append(letters)
            for r, t in zip(roles, texts):
                digest.update(("\n" if started else "").encode() + f"{r}:{t}".encode())
                started = True
        yield key, span[1] - span[0] + 1 - span[2] if span else 0, *counts, illegal, cost, "".join(audit), digest.hexdigest()


def as_batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


SUMMARY = ["gaps bigint", "blank bigint", "duplicate bigint", "truncated bigint", "illegal bigint", "cost bigint", "audit string", "repaired_sha256 string"]


class Repair:
    """Conversations with what is to be done with them; each method is a DataFrame."""

    def __init__(self, df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None):
        self.key = key
        pieces = pieces_of(df, key, turn, role, text, gone)
        bounds = bounds_of(pieces)
        self.kind = pieces.schema["key"].dataType.simpleString()
        # only the first and last piece of a partition can have bounds: no other one takes part in the join
        inner = pieces.filter("not edge").withColumns({c: F.lit(None).cast(bounds.schema[c].dataType) for c in ("dups", "right", "last", "entry")})
        self.pieces = inner.unionByName(pieces.filter("edge").join(bounds, ["part", "run"], "left"))

    def walked(self, pieces: DataFrame, most: int) -> DataFrame:
        kind = self.kind

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = None
            for b in batches:
                schema = b.schema if schema is None else schema
                strings = pa.list_(pa.string())
                kinds = [schema.field("key").type, pa.int32(), pa.list_(pa.int64()), strings, *[pa.int64()] * 5, pa.string(), strings, strings]
                yield from as_batches(walked([b]), [c.split()[0] for c in WALKED.split(", ")], kinds, most)

        return pieces.mapInArrow(run, WALKED.format(kind))

    def messages(self) -> DataFrame:
        """The repaired conversations, a row a message: the key, ``part`` and ``position`` (its order), role and text."""
        rows = self.walked(self.pieces, 512).select("key", "part", F.posexplode(F.arrays_zip("roles", "texts")).alias("position", "m"))
        return rows.select(F.col("key").alias(self.key), "part", "position", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))

    def summaries(self) -> DataFrame:
        """The key and ``SUMMARY``, a row a conversation."""

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from as_batches(summed(walked([b])), names, [b.schema.field("key").type, *kinds])

        def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is not None:
                rows = (row for b in chain([first], batches) for row in zip(*(c.to_pylist() for c in b.columns)))
                yield from as_batches(summed(rows), names, [first.schema.field("key").type, *kinds])

        names = ["key", *(c.split()[0] for c in SUMMARY)]
        kinds = [*[pa.int64()] * 6, pa.string(), pa.string()]
        schema = ", ".join([f"key {self.kind}", *SUMMARY])
        alone = self.pieces.filter("entry is null").mapInArrow(whole, schema)
        parts = self.walked(self.pieces.filter("entry is not null"), 1)
        rest = parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(streamed, schema)
        return alone.union(rest).withColumnRenamed("key", self.key)


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``df`` with faults by crc32 of ``key:turn``, of 20 remainders: 0 drops a row (``gone``), 1 empties its text, 2 takes
    its sentence ends, 3 repeats it, 4 makes it a user's. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space(key), F.lit(":"), space(turn)).cast("binary")) % 20
    rows = df.select(key, turn, space(role).alias(role), space(text).alias(text), code.alias("code"))
    rows = rows.withColumns({text: F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)), role: F.when(F.col("code") == 4, "user").otherwise(F.col(role))})
    copies = F.explode(F.array_repeat(F.col("code") == 0, F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select(key, turn, role, text, copies.alias("gone"))
