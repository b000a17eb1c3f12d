"""Language-model scores from a weighted backoff automaton.

Words, pairs and triples of words are counted over all training texts. Smoothed, they become an automaton: a state for
each pair and each word that was followed by something (and one for the start of a text), an arc for each triple and
pair, and from every state a failure arc to the state of one word less, at last to the root, whose arcs are the single
words. One left-to-right traversal of all texts of a block carries their states and adds up log10 probabilities: a text
takes the arc of its next word, or the failure arc until there is one.

    p(w | u, v) = (c(u, v, w) + PRIOR * p(w | v)) / (c(u, v) + PRIOR)      failure arc of (u, v): PRIOR / (c(u, v) + PRIOR)
    p(w | v) = (c(v, w) + PRIOR * p(w)) / (c(v) + PRIOR)                   failure arc of v: PRIOR / (c(v) + PRIOR)
    p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

Counting: each block of texts hands on its distinct n-grams with their counts, packed as sorted 64-bit hashes by hash
range; a range adds them up and tells a block which of its n-grams have another total, and that. So a frequent word costs
one entry a block, the model is never gathered in one place, and every task's share is bounded by ``BLOCK_CHARS`` and
``RANGE_CHARS`` of text.

Defined results: a null or empty text is the end token alone; rows with a null key are scored and count as training, if
``train`` holds; repeated rows count as often as they are there; without training texts all counts are 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, mix64, settled, slices, text_bytes, word_hashes

#: Chosen among training documents, a fifth of which was kept apart: log10 probability a token there is -4.02 with 5, -3.83 with
#: 20, -3.75 with 60.
PRIOR = 60.0
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
BLOCK_CHARS, RANGE_CHARS = 8 << 20, 12 << 20
#: Tokens counted at once in a task.
FLUSH_TOKENS = 2_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words and the end."""
    return np.append(word_hashes(text, lower=True), END)


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes each as the largest needs (told by the first byte), byte by byte: empty high
    bytes cost nothing, and runs of equal ones compress."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    held = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((held.shape[1], 8), np.uint8)
    out[:, : raw[0]] = held.T
    return out.reshape(-1).view(np.uint64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their steps, the high bytes of which are coded by how often each value occurs."""
    if not len(keys):
        return b""
    steps = planes(np.diff(keys, prepend=keys[:1]))
    cut = len(steps) - len(keys)  # the highest plane
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return keys[:1].tobytes() + len(keys).to_bytes(4, "little") + steps[:cut] + coder.compress(steps[cut:]) + coder.flush()


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    n = int.from_bytes(raw[8:12], "little")
    cut = 13 + (raw[12] - 1) * n
    return np.cumsum(from_planes(raw[12:cut] + zlib.decompress(raw[cut:], -15)), dtype=np.uint64) + np.frombuffer(raw[:8], np.uint64)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, the sums of their counts, and the place of each key among them."""
    if not len(keys):
        return keys, counts.astype(np.int64), np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return ranked[first], np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first)), place


def ngrams(found: list[np.ndarray], train: list[bool], kinds: Sequence[int] = (0, 1, 2)) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts end to end: distinct words, pairs and triples (those of ``kinds``), their counts in texts that train, and the place of the one
    that ends at each token. The start is the word before a text's first; the first token ends no triple (its place is
    that of a key of its own, never counted)."""
    sizes = np.array([len(x) for x in found], np.int64)
    flat = np.concatenate(found) if found else np.empty(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    before = np.append(START, flat[:-1])[: len(flat)]
    before[starts] = START
    used = np.repeat(np.array(train, bool), sizes)
    out = [counted(flat, used)] if 0 in kinds else []
    pair = mix64(before * STEP + flat)
    if 1 in kinds:
        out.append(counted(pair, used))
    if 2 in kinds:
        triple = mix64(np.append(np.uint64(0), pair[:-1])[: len(flat)] * STEP + flat)
        triple[starts], used[starts] = 0, False
        out.append(counted(triple, used))
    return out


def range_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each range starts among sorted keys, and their end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def squeezed(docs: DataFrame) -> DataFrame:
    """``docs`` (k, t, train, block) with the texts compressed, as ``z``: they are shuffled twice."""
    kind = dict(docs.dtypes)["k"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for part in slices(batches):
            texts = [packer.compress(t.encode()) if t else b"" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()), part.column(2), part.column(3)], ["k", "z", "train", "block"])

    return docs.select("k", "t", "train", "block").mapInArrow(run, f"k {kind}, z binary, train boolean, block int")


def text_of(z: bytes) -> str:
    return zstandard.decompress(z).decode() if z else ""


COUNT_SCHEMA = "range int, kind int, block int, keys binary, counts binary"


def block_counts(docs: DataFrame, bits: int, kinds: Sequence[int]) -> DataFrame:
    """Packed counts of each block's n-grams of some kinds, by range of the keys' hashes. ``docs``: z, train, block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, (found, train) in held.items():
                rows = []
                for kind, (keys, counts, _) in zip(kinds, ngrams(found, train, kinds)):
                    cuts = range_cuts(keys, bits)
                    rows += [(part, kind, block, packed(keys[a:b]), planes(counts[a:b])) for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["range", "kind", "block", "keys", "counts"])

        for part in slices(batches, 0):
            for t, train, block in zip(*(part.column(i).to_pylist() for i in range(3))):
                found = tokens(text_of(t))
                own = held.setdefault(block, ([], []))
                own[0].append(found)
                own[1].append(train)
                size += len(found)
                if size > FLUSH_TOKENS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return docs.select("z", "train", "block").mapInArrow(run, COUNT_SCHEMA)


TOTAL_SCHEMA = "block int, range int, kind int, differ binary, totals binary, tokens long, distinct long"


def range_totals(counts: DataFrame, bits: int) -> DataFrame:
    """For each block, which of its keys of a range (in their order, as bits) have a total that isn't what the block
    counted itself, and those totals; and a row with the block -1 for each range of words: how many training tokens and
    distinct ones it has."""

    def total(rows: pa.Table) -> pa.Table:
        kind, part = rows["kind"][0].as_py(), rows["range"][0].as_py()
        own: dict[int, list] = {}
        for block, k, c in zip(rows["block"].to_pylist(), rows["keys"].to_pylist(), rows["counts"].to_pylist()):
            own.setdefault(block, []).append((unpacked(k), from_planes(c).astype(np.int64)))
        # what a task counted in several goes is one
        blocks = {b: x[0] if len(x) == 1 else counted(*(np.concatenate(y) for y in zip(*x)))[:2] for b, x in own.items()}
        _, sums, place = counted(np.concatenate([k for k, _ in blocks.values()]), np.concatenate([c for _, c in blocks.values()]))
        out, at = [], 0
        for block, (k, c) in blocks.items():
            totals = sums[place[at : at + len(k)]]
            at += len(k)
            differ = totals != c
            if differ.any():
                out.append((block, part, kind, np.packbits(differ).tobytes(), planes(totals[differ]), 0, 0))
        if kind == 0:
            out.append((-1, part, 0, b"", b"", int(sums.sum()), int((sums > 0).sum())))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in TOTAL_SCHEMA.split(", ")]
        give_back()
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, kinds))})

    return counts.groupBy("range", "kind").applyInArrow(total, TOTAL_SCHEMA)


class Automaton:
    """The part of the model that a block of texts can reach: states are numbered, the root is 0, then words, the start,
    and pairs. An arc is found by the token it is taken at."""

    def __init__(self, found: list[np.ndarray], grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, v: int, starts: int, prior: float):
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        (words, one, word), (_, two, pair), (_, three, triple) = grams
        self.known = one[word] > 0
        # counts of the n-grams that end at a token, and of what stands before it
        c1, c2, c3 = one[word], two[pair], three[triple]
        c3[self.starts] = 0
        before1, before2 = np.append(0, c1[:-1])[: len(c1)], np.append(0, c2[:-1])[: len(c1)]
        before1[self.starts], before2[self.starts] = starts, 0
        p1 = (c1 + 0.5) / (n + 0.5 * (v + 1))
        p2 = (c2 + prior * p1) / (before1 + prior)
        p3 = (c3 + prior * p2) / (before2 + prior)
        self.root = np.log10(p1)
        self.arc2, self.arc3 = np.where(c2 > 0, np.log10(p2), np.nan), np.where(c3 > 0, np.log10(p3), np.nan)
        # states: only what was followed by something is one
        self.start = 1 + len(words) if starts else 0
        of_word = np.where((one > 0) & (words != END), 1 + np.arange(len(words)), 0)
        of_pair = np.where(two > 0, 2 + len(words) + np.arange(len(two)), 0)
        self.after_word, self.after_pair = of_word[word], of_pair[pair]
        self.first_pair = 2 + len(words)
        size = 2 + len(words) + len(two)
        self.failure, self.penalty = np.zeros(size, np.int64), np.zeros(size)
        self.penalty[1 : 1 + len(words)] = np.log10(prior / (one + prior))
        self.penalty[1 + len(words)] = math.log10(prior / (starts + prior))
        self.penalty[self.first_pair :] = np.log10(prior / (two + prior))
        self.failure[self.first_pair + pair] = of_word[word]

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score of each text."""
        order = np.argsort(-self.lengths, kind="stable")
        at, left = self.starts[order], self.lengths[order]
        state = np.full(len(order), self.start)
        total = np.zeros(len(order))
        for step in range(int(left[0]) if len(left) else 0):
            active = int(np.searchsorted(-left, -step, side="left"))  # texts longer than the steps made
            here, s = at[:active] + step, state[:active]
            weight, deep = self.arc3[here], s >= self.first_pair
            failed = deep & np.isnan(weight)
            taken = deep ^ failed
            add = np.where(taken, weight, np.where(failed, self.penalty[s], 0.0))
            s = np.where(failed, self.failure[s], s)
            weight, held = self.arc2[here], (s > 0) & ~taken
            failed = held & np.isnan(weight)
            add += np.where(held, np.where(failed, self.penalty[s], weight), 0.0)
            taken |= held ^ failed
            total[:active] += np.where(taken, add, add + self.root[here])
            state[:active] = np.where(taken, self.after_pair[here], self.after_word[here])
        score = np.empty(len(order))
        score[order] = total
        return np.add.reduceat(self.known.astype(np.int64), self.starts), np.add.reduceat(self.root, self.starts), score


def lm_scores(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", prior: float = PRIOR) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; rows where ``train`` holds
    are learned from. Blocks are dealt by key and text, so rows that share a key are spread."""
    chars = text_bytes(df, text)
    blocks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / BLOCK_CHARS))
    bits = max(0, math.ceil(math.log2(max(1, chars / RANGE_CHARS))))
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    docs = squeezed(docs.withColumn("block", F.pmod(F.hash("k", "t"), F.lit(blocks))))
    # triples after the rest: what is counted is on the disks once, and triples are as much as words and pairs
    totals = reduce(DataFrame.union, [settled(range_totals(block_counts(docs.repartition(blocks, "block"), bits, kinds), bits)) for kinds in ((0, 1), (2,))])
    n, v = totals.filter("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    starts = docs.filter("train").count()
    kind = dict(df.dtypes)[key]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, trains = [tokens(text_of(z)) for z in left["z"].to_pylist()], left["train"].to_pylist()
        grams = ngrams(found, trains)
        cuts = [range_cuts(keys, bits) for keys, _, _ in grams]
        for part, which, differ, totals in zip(*(right[c].to_pylist() for c in ("range", "kind", "differ", "totals"))):
            a, b = cuts[which][part : part + 2]
            own = grams[which][1][a:b]
            own[np.unpackbits(np.frombuffer(differ, np.uint8), count=b - a).astype(bool)] = from_planes(totals)
        out = {"k": left["k"], "held_out": pa.array([not x for x in trains], pa.bool_()), "n_tokens": pa.array([len(x) for x in found], pa.int64())}
        known, base, score = Automaton(found, grams, n, v, starts, prior).scores() if found else (np.empty(0),) * 3
        out |= {"n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(found), n), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())}
        give_back()
        return pa.table(out)

    schema = f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("block").cogroup(totals.filter("block >= 0").select("block", "range", "kind", "differ", "totals").groupBy("block")).applyInArrow(run, schema).withColumnRenamed("k", key)
