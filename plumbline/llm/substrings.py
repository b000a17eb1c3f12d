"""Substring dedup: repeated passages are confirmed, compiled into sharded Aho-Corasick automata, and located.

1. Of every ``window`` consecutive words the run of ``ANCHOR`` words with the smallest hash is its anchor, so equal
   windows have equal anchors; only anchors that two documents share (a fifth of the positions go in, a partial minimum
   and maximum come out) can belong to a repeated window.
2. Windows with such an anchor meet by ranges of their hashes, packed, one entry for each window and block of documents;
   one that starts in two documents recurs. Its first document is the smallest.
3. The first documents hand their recurring passages, word by word, to the blocks that hold later documents with them.
4. A block compiles the anchors of its passages, as phrases of words, into Aho-Corasick automata of bounded size and
   streams all its documents through each. Around every occurrence the windows are compared with the passages, word by
   word, and those that a smaller document's passage has are marked. Nothing but the automata says where to look.

A window that stands in very many documents costs one entry a block. Blocks hold about ``BLOCK_CHARS`` of text, automata
``SHARD_PHRASES`` phrases, so tasks are bounded; nothing is sampled or capped. Hashes only propose: no two windows are
taken for equal by them (two unequal ones of one 64-bit hash could hide the one that starts in the larger document).

Defined results: null and empty texts have no words; a document with a null key is neither a source nor changed; rows
with equal keys aren't before each other; a text shorter than the window stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain, compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, discard, give_back, joined_hashes, rolled, settled, slices, text_bytes, word_hashes, words_of

ANCHOR = 5
BLOCK_CHARS = 8 << 20
SHARD_PHRASES = 50_000
#: Words of the texts that are streamed through an automaton at once; a longer text is alone.
STREAM_WORDS = 1 << 16
#: Windows gathered before a task hands on their distinct ones; characters of text whose windows meet in one range.
FLUSH_WINDOWS, RANGE_CHARS = 400_000, 32 << 20
#: A word is written as two letters from these many, the first and the second kind apart, so that no node of an
#: automaton has more children and no phrase matches across words.
LETTERS = 1024


def anchors_of(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window of a text, given its words' hashes."""
    runs = rolled(hashes, min(ANCHOR, window))
    span = window - min(ANCHOR, window) + 1
    if len(runs) < span:
        return np.empty(0, np.uint64)
    out = runs[: len(runs) - span + 1]
    for k in range(1, span):
        out = np.minimum(out, runs[k : len(runs) - span + 1 + k])
    return out


def windows_of(texts: list[str | None], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the words of several texts, one behind the other; where the windows within a text start, and which text
    that is."""
    hashes, counts = joined_hashes(texts)
    own = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(np.arange(len(own)) + window <= np.cumsum(counts)[own])
    return hashes, starts, own[starts]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(out)


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values the ordered ones hold."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def block_count(df: DataFrame, text: str, chars: int = BLOCK_CHARS) -> int:
    """Blocks of about ``chars`` of text, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(text_bytes(df, text) / chars))


def shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """``k, shared``: the anchors of each document that another has too; no ``k`` is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, starts, own = windows_of(part.column(1).to_pylist(), window)
            anchors = anchors_of(hashes, window)[starts]
            heads = changes(anchors, own)
            anchors, own = anchors[heads], own[heads]
            order = np.argsort(anchors, kind="stable")  # an anchor's texts stay in order
            anchors, own = anchors[order], own[order]
            heads = changes(anchors, own)
            k = part.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(anchors[heads].view(np.int64)), pa.array(k[own[heads]])], ["anchor", "k"])

    anchors = arrow_map(docs.select("k", "t"), run, "anchor long, k long")
    recurring = anchors.groupBy("anchor").agg(F.min("k").alias("a"), F.max("k").alias("b")).filter("a < b").select("anchor")
    return anchors.join(recurring, "anchor").groupBy("k").agg(F.collect_set("anchor").alias("shared"))


PACKED = "range int, block int, w binary, least binary, several binary"


def recurring_windows(docs: DataFrame, lists: DataFrame, window: int, blocks: int, bits: int) -> DataFrame:
    """``source, w, first, block`` (packed): the windows that blocks hold in a document behind the one they first start
    in; ``source`` is the block of that one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            """One entry for each window and block: its least document, and whether there are several."""
            w, block, k = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(w)
            if len(changes(block)) > 1:
                order = order[np.argsort(block[order], kind="stable")]
            w, block, k = w[order], block[order], k[order]
            heads = changes(w, block)
            least = np.minimum.reduceat(k, heads)
            several = np.maximum.reduceat(k, heads) > least
            w, block = w[heads], block[heads]
            part = (w >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(w), np.int64)
            cuts = [*np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (block[1:] != block[:-1]))).tolist(), len(w)]
            rows = [(int(part[a]), int(block[a]), w[a:b].tobytes(), least[a:b].tobytes(), several[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["range", "block", "w", "least", "several"])

        for part in slices(batches):
            hashes, starts, own = windows_of(part.column(1).to_pylist(), window)
            anchors = anchors_of(hashes, window)[starts]
            heads = changes(anchors)
            # an anchor that one of the texts shares is shared by all that have it
            shared = within(anchors[heads], np.unique(part.column(2).flatten().to_numpy().view(np.uint64)))
            found = np.repeat(shared, np.diff(np.append(heads, len(anchors))))
            w, own = rolled(hashes, window)[starts[found]], own[found]
            held.append((w, part.column(3).to_numpy()[own], part.column(0).to_numpy()[own]))
            size += len(w)
            if size > FLUSH_WINDOWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def confirm(rows: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, np.uint64) for x in rows["w"].to_pylist()]
        block = np.repeat(rows["block"].to_numpy(), [len(x) for x in found])
        w = np.concatenate(found)
        k = np.frombuffer(b"".join(rows["least"].to_pylist()), np.int64)
        several = np.frombuffer(b"".join(rows["several"].to_pylist()), bool)
        order = np.lexsort((k, w))
        w, k, block, several = w[order], k[order], block[order], several[order]
        heads = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        own = np.repeat(heads, np.diff(np.append(heads, len(w))))  # where the window's first document stands
        later = np.flatnonzero((k > k[own]) | several)
        source, first = block[own[later]], k[own[later]]
        order = np.argsort(source, kind="stable")
        later, source, first = later[order], source[order], first[order]
        cuts = [*np.flatnonzero(np.append(True, source[1:] != source[:-1])).tolist(), len(source)] if len(source) else [0]
        out = [(int(source[a]), w[later[a:b]].tobytes(), first[a:b].tobytes(), block[later[a:b]].astype(np.int32).tobytes()) for a, b in zip(cuts, cuts[1:])]
        columns = list(zip(*out)) if out else [[]] * 4
        give_back()
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("source", "w", "first", "block"), columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))})

    both = docs.repartition(blocks, "k").join(lists.withColumnRenamed("k", "lk").repartition(blocks, "lk"), F.col("k") == F.col("lk"))
    rows = arrow_map(both.select("k", "t", "shared", "block"), run, PACKED)
    return rows.groupBy("range").applyInArrow(confirm, "source int, w binary, first binary, block binary")


def passages(docs: DataFrame, recurring: DataFrame, window: int) -> DataFrame:
    """``to, first, passage``: for each block that later documents of a recurring window stand in, the longest runs of
    such windows of each first document, as words joined by spaces."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        w, first, block = (np.frombuffer(b"".join(right[c].to_pylist()), t) for c, t in (("w", np.uint64), ("first", np.int64), ("block", np.int32)))
        order = np.lexsort((w, block, first))
        w, first, block = w[order], first[order], block[order]
        keys, edges = np.unique(first, return_index=True)
        edges = dict(zip(keys.tolist(), zip(edges.tolist(), [*edges[1:].tolist(), len(first)])))
        out: list[tuple[int, int, str]] = []
        for part in slices(left.to_batches(), 2):
            here = [(k, t) for k, t in zip(part["k"].to_pylist(), part["t"].to_pylist()) if k in edges]
            hashes, counts = joined_hashes(t for _, t in here)
            runs, ends = rolled(hashes, window), np.cumsum(counts)
            for (k, t), n, end in zip(here, counts.tolist(), ends.tolist()):
                a, b = edges[k]
                words, own = words_of(t), runs[end - n : max(end - n, end - window + 1)]
                for lo, hi in _runs(block[a:b]):
                    held = np.concatenate([[False], within(own, w[a + lo : a + hi]), [False]])
                    turns = np.flatnonzero(held[1:] != held[:-1])
                    out += [(int(block[a + lo]), k, b" ".join(words[i : j + window - 1]).decode()) for i, j in zip(turns[0::2].tolist(), turns[1::2].tolist())]
        columns = list(zip(*out)) if out else [[]] * 3
        give_back()
        return pa.table({"to": pa.array(columns[0], pa.int32()), "first": pa.array(columns[1], pa.int64()), "passage": pa.array(columns[2], pa.string())})

    return docs.select("block", "k", "t").groupBy("block").cogroup(recurring.groupBy("source")).applyInArrow(run, "to int, first long, passage string")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edges = [*np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist(), len(values)] if len(values) else [0]
    return list(zip(edges, edges[1:]))


class Passages:
    """The recurring passages of a block: their words as numbers, and an index of their windows."""

    def __init__(self, texts: list[str], firsts: list[int], window: int):
        self.window, self.size = window, min(ANCHOR, window)
        split = [words_of(t) for t in texts]
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        lengths = np.array([len(words) for words in split])
        ends = np.cumsum(lengths)
        self.words = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]))
        inside = np.arange(len(self.words)) + window <= np.repeat(ends, lengths)  # a window that ends in its passage
        starts, first = np.flatnonzero(inside), np.repeat(np.array(firsts), lengths)[inside]
        runs = rolled(word_hashes(" ".join(texts)), self.size)
        span = np.lib.stride_tricks.sliding_window_view(runs, window - self.size + 1)
        anchors = np.unique(starts + span[starts].argmin(1))
        for seed in range(1, 1000):  # until no two unequal windows have one hash
            self.seed = np.uint64(seed)
            hashes = self._hashes(self.words)[starts]
            order = np.lexsort((first, hashes))
            ranked, at = hashes[order], starts[order]
            twin = np.flatnonzero(ranked[1:] == ranked[:-1])
            if all((self.words[at[twin] + i] == self.words[at[twin + 1] + i]).all() for i in range(window)):
                break
        once = np.append(True, ranked[1:] != ranked[:-1])
        self.hashes, self.starts, self.first = ranked[once], at[once], first[order][once]
        self.phrases = np.unique(self.words[anchors[:, None] + np.arange(self.size)], axis=0)

    def _hashes(self, words: np.ndarray) -> np.ndarray:
        return rolled(words.astype(np.uint64) * np.uint64(2) + self.seed, self.window)

    @staticmethod
    def letters(words: np.ndarray) -> str:
        """Two letters a word; two spaces for a word (-1) that no passage has."""
        out = np.full((len(words), 2), 32, "<u4")
        known = words >= 0
        out[known, 0], out[known, 1] = 0x100 + words[known] // LETTERS, 0x10000 + words[known] % LETTERS
        return out.tobytes().decode("utf-32-le")

    def automata(self) -> Iterator[ahocorasick.Automaton]:
        for lo in range(0, len(self.phrases), SHARD_PHRASES):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            written = self.letters(self.phrases[lo : lo + SHARD_PHRASES].ravel())
            for i in range(0, len(written), 2 * self.size):
                automaton.add_word(written[i : i + 2 * self.size])
            automaton.make_automaton()
            yield automaton

    def earlier(self, words: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Those of the starts at which a window stands that a passage from a key smaller than theirs has, word by word."""
        hashes = self._hashes(words)[starts]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = (self.hashes[at] == hashes) & (self.first[at] < keys)
        starts, at = starts[same], self.starts[at[same]]
        equal = np.ones(len(starts), bool)
        for i in range(self.window):
            equal &= words[starts + i] == self.words[at + i]
        return starts[equal]


def _marks(keys: list, texts: Iterable[list[bytes]], held: list[str], firsts: list[int], window: int) -> list[np.ndarray]:
    """For each document of a block, which words a window covers that a smaller key's passage has. ``texts`` may come one
    by one: only the numbers of their words are kept, as an object for each word takes ten times as much."""
    known = Passages(held, firsts, window) if held else None
    marks, streams = [], []
    for n, (k, words) in enumerate(zip(keys, texts)):
        marks.append(np.zeros(len(words), bool))
        if known and k is not None and len(words) >= window:  # a word that no passage has ends it: nothing matches across texts
            streams.append((n, np.fromiter(chain(map(known.numbers.get, words, repeat(-1)), [-1]), np.int32, len(words) + 1)))
    if not streams:
        return marks
    sizes = np.array([len(numbers) for _, numbers in streams])
    joined = []
    for lo, hi in _runs((np.cumsum(sizes) - sizes) // STREAM_WORDS):
        numbers = np.concatenate([numbers for _, numbers in streams[lo:hi]])
        joined.append(([n for n, _ in streams[lo:hi]], sizes[lo:hi], numbers, np.zeros(len(numbers), bool)))
    del streams
    for automaton in known.automata():
        for at, lengths, numbers, covered in joined:
            ends = np.array([end for end, _ in automaton.iter(known.letters(numbers))], np.int64)
            if not len(ends):
                continue
            found = np.zeros(len(numbers) - known.size + 1, bool)
            found[ends // 2 - known.size + 1] = True
            near = _spread(found, len(numbers) - window + 1)
            starts = np.flatnonzero(near)
            own = np.repeat(np.array([keys[n] for n in at]), lengths)[starts]
            near[:] = False
            near[known.earlier(numbers, starts, own)] = True
            for i in range(window):
                covered[i : i + len(near)] |= near
    for at, lengths, _, covered in joined:
        for n, part in zip(at, np.split(covered, np.cumsum(lengths)[:-1])):
            marks[n] = part[:-1]
    return marks


def _spread(found: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` places, whether anything is found from there to the last place that a window from there has."""
    out = found[:size].copy()
    for back in range(1, len(found) - size + 1):
        out |= found[back : back + size]
    return out


def dedup_substrings(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """``key, n_words, n_removed, kept_text``: each word covered by a ``window``-word passage that also starts in a row
    with a smaller key is removed; the kept words are joined by one space. Windows are judged on the input."""
    blocks = block_count(df, text)
    docs = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    # without a key a row is only passed on: dealt by its text
    docs = docs.withColumn("block", F.pmod(F.when(F.col("k").isNull(), F.hash("t")).otherwise(F.hash("k")), F.lit(blocks)))
    keyed = docs.filter("k is not null")
    lists = settled(shared_anchors(keyed, window))
    bits = max(0, math.ceil(math.log2(max(1, blocks * BLOCK_CHARS / RANGE_CHARS))))
    recurring = settled(recurring_windows(keyed, lists, window, blocks, bits))
    discard(lists)
    held = settled(passages(keyed, recurring, window))
    discard(recurring)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts = left["k"].to_pylist(), left["t"].to_pylist()
        marks = _marks(keys, map(words_of, texts), right["passage"].to_pylist(), right["first"].to_pylist(), window)
        kept = []
        for text, mark in zip(texts, marks):
            words = words_of(text)
            kept.append(b" ".join(compress(words, (~mark).tolist()) if mark.any() else words).decode())
        out = pa.table({"k": pa.array(keys, pa.int64()), "n_words": pa.array([len(m) for m in marks], pa.int64()), "n_removed": pa.array([int(m.sum()) for m in marks], pa.int64()), "kept_text": pa.array(kept, pa.string())})
        del texts, marks, kept  # before memory goes back: an idle worker keeps the rest
        give_back()
        return out

    out = docs.groupBy("block").cogroup(held.groupBy("to")).applyInArrow(run, "k long, n_words long, n_removed long, kept_text string")
    return out.select(F.col("k").cast(dict(df.dtypes)[key]).alias(key), "n_words", "n_removed", "kept_text")
