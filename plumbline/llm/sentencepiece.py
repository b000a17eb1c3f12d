"""SentencePiece (BPE) encoding and decoding in vectorised merge rounds.

A batch's distinct words become one flat array of symbol ids. In each round every adjacent pair is ranked, a segmented
minimum gives the best pair of each segment, all its leftmost non-overlapping occurrences merge at once, the array is
compacted, and segments without a pair leave; the rounds end when none is left. Decoding gathers piece bytes by id.

Defined results: a null or empty text has the end id only and decodes to "". Texts are processed whole; a text of one
endless word is cut only where no piece of the vocabulary spans the two characters, which changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import arrow_map, slices

SPACE = "▁"
NONE = np.int32(-1)
NO_RANK = np.iinfo(np.int32).max
#: The pair table has 2 ** SLOT_BITS slots.
SLOT_BITS = 19
#: Words a worker keeps encoded before it empties its cache.
CACHE_WORDS = 50_000
#: Characters of new words encoded at once.
ROUND_CHARS = 1 << 17
#: Bytes of text encoded at once: each takes about thirty in words and ids.
ENCODE_BYTES = 1 << 18


@dataclass(frozen=True)
class PieceModel:
    """Tables of one model, about 5 MB: bounded by its vocabulary, so closures may carry them."""

    size: int
    end: int
    unk: int
    first_byte: int
    char_ids: np.ndarray  # by code point; NONE where it is no piece
    touching: np.ndarray  # left << 21 | right of code points that stand side by side in some piece, sorted
    pairs: np.ndarray  # hash table of left * size + right of pieces whose concatenation is a piece; -1 is empty
    pair_rank: np.ndarray  # by slot
    pair_id: np.ndarray
    out: tuple[bytes, ...]  # what each piece decodes to
    is_byte: np.ndarray
    silent: np.ndarray
    spaced: np.ndarray  # pieces that start with a space


def load_model(path: str) -> PieceModel:
    """Reads the vocabulary on the driver; merging and decoding are this module's own."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte, silent, unk = ([bool(f(i)) for i in range(n)] for f in (sp.is_byte, sp.is_control, sp.is_unknown))
    normal = {p: i for i, p in enumerate(pieces) if not (byte[i] or silent[i] or unk[i])}
    if any(c != SPACE and d == SPACE for p in normal for c, d in zip(p, p[1:])):
        raise ValueError("a piece spans two words; this encoder splits at spaces first")
    by_score = sorted(normal.values(), key=lambda i: (-sp.get_score(i), i))
    rank = {i: r for r, i in enumerate(by_score)}
    found = {normal[p[:k]] * n + normal[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
    if 2 * len(found) > 1 << SLOT_BITS:
        raise ValueError(f"{len(found)} pairs are more than half of the table's slots")
    slots = np.full(1 << SLOT_BITS, -1, np.int64)
    for key in found:
        at = int(_slot(np.array([key]))[0])
        while slots[at] >= 0:
            at = (at + 1) % len(slots)
        slots[at] = key
    kept = [found.get(k, -1) for k in slots.tolist()]
    char_ids = np.full(0x110000, NONE, np.int32)
    for p, i in normal.items():
        if len(p) == 1:
            char_ids[ord(p)] = i
    outs = [bytes([int(p[3:5], 16)]) if byte[i] else b"" if silent[i] else " ⁇ ".encode() if unk[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    model = PieceModel(
        size=n,
        end=sp.eos_id(),
        unk=sp.unk_id(),
        first_byte=byte.index(True) if any(byte) else -1,
        char_ids=char_ids,
        touching=np.unique(np.array([ord(c) << 21 | ord(d) for p in normal for c, d in zip(p, p[1:])], np.int64)),
        pairs=slots,
        pair_rank=np.array([rank.get(i, NO_RANK) for i in kept], np.int32),
        pair_id=np.array(kept, np.int32),
        out=tuple(outs),
        is_byte=np.array(byte),
        silent=np.array(silent),
        spaced=np.array([p.startswith(SPACE) for p in pieces]) & ~np.array(silent) & ~np.array(byte),
    )
    probes = ["", "a", "  two  spaces ", "x\ty\nz", "\ufb01 \u00c5 A\u030a \u00bd \uff21", "\u00a0n\u3000w\u200b", "The end."]
    for text, ids in zip(probes, Encoder(model).encode(probes)):
        if ids.tolist() != sp.encode(text, add_eos=True) or decode(model, ids) != sp.decode(ids.tolist()):
            raise ValueError(f"the model normalizes or prefixes texts in another way than this encoder: {text!r}")
    return model


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot that holds each key, or an empty one."""
    at = _slot(keys)
    held = table[at]
    rest = np.flatnonzero((held != keys) & (held >= 0))
    while len(rest):
        at[rest] = (at[rest] + 1) % len(table)
        held = table[at[rest]]
        rest = rest[(held != keys[rest]) & (held >= 0)]
    return at


def merge_rounds(m: PieceModel, words: list[str]) -> list[bytes]:
    """The ids (int32, as bytes) of each word."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not len(code):
        return [b""] * len(words)
    symbols = m.char_ids[code]
    place = np.arange(len(code))  # the first character of each symbol: keeps the order of what is done
    fresh = np.ones(len(code), bool)
    starts = np.cumsum(sizes) - sizes
    beside = code[:-1] << 21 | code[1:]
    fresh[1:] = m.touching[np.minimum(np.searchsorted(m.touching, beside), len(m.touching) - 1)] != beside
    fresh[starts[sizes > 0]] = True
    segment = np.cumsum(fresh) - 1
    final = np.full(len(code), NONE - 1, np.int32)  # at its place, the id of a symbol that is done
    while len(symbols):
        same = segment[1:] == segment[:-1]
        rank, at = np.full(len(symbols), NO_RANK, np.int32), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(same & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
        at[inner] = _lookup(m.pairs, symbols[inner].astype(np.int64) * m.size + symbols[inner + 1])
        rank[inner] = m.pair_rank[at[inner]]
        heads = np.flatnonzero(np.append(True, ~same))
        least = np.minimum.reduceat(rank, heads)
        lengths = np.diff(np.append(heads, len(symbols)))
        alive = np.repeat(least < NO_RANK, lengths)
        final[place[~alive]] = symbols[~alive]
        best = np.flatnonzero(alive & (rank == np.repeat(least, lengths)))
        if not len(best):
            break
        run = np.append(True, np.diff(best) != 1)  # overlapping occurrences: every other one from the left
        first = np.maximum.accumulate(np.where(run, np.arange(len(best)), 0))
        best = best[(np.arange(len(best)) - first) % 2 == 0]
        symbols = symbols.copy()
        symbols[best] = m.pair_id[at[best]]
        keep = alive
        keep[best + 1] = False
        symbols, segment, place = symbols[keep], segment[keep], place[keep]
    done = np.flatnonzero(final >= NONE)
    ids, count = final[done], np.ones(len(done), np.int64)
    strange = np.flatnonzero(ids == NONE)
    if len(strange):
        raw = [chr(c).encode() for c in code[done[strange]].tolist()]
        if m.first_byte < 0:
            ids[strange] = m.unk
        else:
            count[strange] = [len(b) for b in raw]
            ids = np.repeat(ids, count)
            ids[ids == NONE] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + m.first_byte
    ends = np.append(0, np.cumsum(count))[np.searchsorted(done, np.append(starts, len(code)))] * 4
    flat = ids.astype(np.int32).tobytes()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Encoder:
    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, the end id last."""
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = set().union(*split)
        part, size = [], 0
        for w in [*new, None]:
            if w is None or size > ROUND_CHARS:
                self.known.update(zip(part, merge_rounds(self.model, [SPACE + x for x in part])))
                part, size = [], 0
            if w is not None:
                part.append(w)
                size += len(w) + 1
        end = np.int32(self.model.end).tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)) + end, np.int32) for words in split]

    @staticmethod
    def words(text: str | None) -> list[str]:
        """What follows each run of spaces up to the next; of the run (one space is put before the text) all but the
        first space stays."""
        if not text:
            return []
        pieces = text.replace(SPACE, " ").split(" ")
        if "" not in pieces:
            return pieces
        out, run = [], ""
        for p in pieces[:-1]:
            if p:
                out.append(run + p)
                run = ""
            else:
                run += SPACE
        return [*out, run + pieces[-1]]


def decode(m: PieceModel, ids: np.ndarray) -> str:
    """The text of a sequence of ids: pieces joined, one leading space dropped."""
    if len(ids) and (ids.min() < 0 or ids.max() >= m.size):
        raise ValueError("an id is not in the vocabulary")
    row = ids.tolist()
    raw = b"".join(map(m.out.__getitem__, row))
    first = next((i for i in row if not m.silent[i]), None)
    try:
        return (raw[1:] if first is not None and m.spaced[first] else raw).decode()
    except UnicodeDecodeError:
        return _decode_broken(m, ids)


def _decode_broken(m: PieceModel, ids: np.ndarray) -> str:
    """Byte pieces that form no character: each becomes U+FFFD."""
    parts, run, first = [], b"", True
    for i in [*ids.tolist(), None]:
        if i is not None and m.is_byte[i]:
            run += bytes([i - m.first_byte])
            first = False
            continue
        while run:
            n = next((k for k in (1, 2, 3, 4) if k <= len(run) and _is_char(run[:k])), 0)
            parts.append(run[:n].decode() if n else "�")
            run = run[n or 1 :]
        if i is not None and not m.silent[i]:
            text = m.out[i].decode()
            parts.append(text[1:] if first and m.spaced[i] else text)
            first = False
    return "".join(parts)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def token_columns(ids: list[np.ndarray], decoded: list[str]) -> list[pa.Array]:
    """The operator's own outputs: ``ids array<int>, decoded string``."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    offsets = np.append(0, np.cumsum([len(r) for r in ids]))
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())]


def encode(df: DataFrame, model: PieceModel, key: str, text: str = "text", derive: Callable = token_columns, schema: str = "ids array<int>, decoded string") -> DataFrame:
    """``key`` and, for every row's whole text, its ids (end id last) and what they decode to.

    ``derive`` turns the ids and decoded texts of a slice into the columns of ``schema``, in the same pass. A pure map:
    no shuffle, memory bounded by the longest text and one bounded cache. Null keys are kept, repeated rows stay
    repeated, other columns are not read.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for part in slices(batches, most=ENCODE_BYTES):
            ids = encoder.encode(part.column(1).to_pylist())
            columns = derive(ids, [decode(model, row) for row in ids])
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", *(f"c{i}" for i in range(len(columns)))])

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    out = arrow_map(df.select(df[key].alias("key"), df[text].alias("text")), run, ", ".join([f"key {kind}", *(f"c{i} {k}" for i, k in enumerate(kinds))]))
    return out.toDF(key, *names)
