"""Fill-in-middle: a text is cut at two places between units and its parts are reordered around sentinels.

A unit is a run of ASCII letters or any other single character. All rows of an Arrow batch are cut at once, on the flat
UTF-8 buffer: a byte-class lookup tells letters and continuation bytes, a mask over adjacent bytes marks where units
start, a cumulative sum that starts anew at each document numbers them, and a binary search in it finds the cuts of all
rows together. Outputs are joined from slices of the same buffer; the way back finds the sentinels in the output's bytes.

Where a row is cut depends on its key alone: the first four groups of eight hex digits of sha256("1:" + key) are h1 to h4.
The prefix ends after min(h1 % (n + 1), h2 % (n + 1)) units, the middle after the larger; the form is ``plain`` if
h3 % 100 is ``plain_from`` or more, else ``spm`` if h4 % 100 is below ``spm_below``, else ``psm``.

Defined results: null and empty texts, and texts that hold a sentinel, stay ``plain``, so that every output can be told
apart; a null key counts as an empty one; repeated rows give repeated results; extra columns aren't read. A pure map:
texts are whole, memory is bounded by the longest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])

#: Classes of bytes: letters, bytes that go on with a character, all others.
LETTER, CONTINUES = 1, 2
CLASS = np.zeros(256, np.uint8)
CLASS[ord("A") : ord("Z") + 1] = CLASS[ord("a") : ord("z") + 1] = LETTER
CLASS[0x80:0xC0] = CONTINUES


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows in them; null rows are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def occurrences(raw: np.ndarray, offsets: np.ndarray, what: bytes) -> np.ndarray:
    """Where ``what`` begins in the buffer, but for places that reach from one row into the next."""
    n = len(raw) - len(what) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hit = np.ones(n, bool)
    for i, byte in enumerate(what):
        hit &= raw[i : i + n] == byte
    at = np.flatnonzero(hit)
    return at[at + len(what) <= offsets[np.searchsorted(offsets, at, side="right")]]


def rows_with(raw: np.ndarray, offsets: np.ndarray, what: bytes) -> np.ndarray:
    found = np.zeros(len(offsets) - 1, bool)
    found[np.searchsorted(offsets, occurrences(raw, offsets, what), side="right") - 1] = True
    return found


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each byte, whether a unit starts there: no continuation byte, and no letter next to a letter of its row."""
    kind = CLASS[raw]
    starts = kind != CONTINUES
    starts[1:] &= (kind[1:] != LETTER) | (kind[:-1] != LETTER)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = True
    return starts


def cut_points(raw: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each row and the bytes where its prefix and its middle end; ``draws`` holds h1 and h2, a row each."""
    starts = unit_starts(raw, offsets)
    total = np.concatenate([[0], np.cumsum(starts)])
    before = total[offsets[:-1]]  # what the sum had reached where a row begins: taken off, it starts anew there
    units = total[offsets[1:]] - before
    low, high = np.sort(draws % (units + 1)[:, None], axis=1).T

    def ends(after: np.ndarray) -> np.ndarray:
        # the first byte whose unit is number ``after`` (from 0) of its row, or the row's end if there is none
        at = np.searchsorted(total[1:], before + after + 1)
        return np.where(after == units, offsets[1:], at)

    return units, ends(low), ends(high)


def characters(raw: np.ndarray) -> np.ndarray:
    """How many characters start before each byte of the buffer, and in all."""
    return np.concatenate([[0], np.cumsum(CLASS[raw] != CONTINUES)])


def pieces(raw: np.ndarray, *bounds: np.ndarray) -> list[pa.Array]:
    """The bytes between each two of the ``bounds`` (arrays of one length), as columns cut from the shared buffer."""
    flat = np.stack(bounds, 1).reshape(-1)
    n = len(bounds)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(len(flat) - 1, 0), [None, pa.py_buffer(np.append(flat, flat[-1:])), pa.py_buffer(np.ascontiguousarray(raw))])
    rows = len(bounds[0])
    return [whole.take(pa.array(np.arange(rows) * n + i)) if rows else pa.array([], pa.large_binary()) for i in range(n - 1)]


def joined(*parts: pa.Array | bytes) -> pa.Array:
    """Columns and constants, row by row one after the other."""
    given = [pa.scalar(p, pa.large_binary()) if isinstance(p, bytes) else p for p in parts]
    return pc.binary_join_element_wise(*given, pa.scalar(b"", pa.large_binary()))


def transform(column: pa.Array, draws: np.ndarray, plain_from: int, spm_below: int) -> dict:
    """All rows of a slice: ``n, form`` (codes), ``prefix_chars, middle_chars`` and ``output`` (binary). ``draws``: h1 to
    h4, a row each."""
    raw, offsets = buffer_of(column)
    units, p, m = cut_points(raw, offsets, draws[:, :2])
    marked = rows_with(raw, offsets, PREFIX) | rows_with(raw, offsets, SUFFIX) | rows_with(raw, offsets, MIDDLE)
    form = np.where(draws[:, 3] % 100 < spm_below, SPM, PSM)
    form[(units == 0) | marked | (draws[:, 2] % 100 >= plain_from)] = PLAIN
    before, middle, after = pieces(raw, offsets[:-1], p, m, offsets[1:])
    plain = joined(before, middle, after)
    psm = joined(PREFIX, before, SUFFIX, after, MIDDLE, middle)
    spm = joined(SUFFIX, after, PREFIX, before, MIDDLE, middle)
    chars = characters(raw)
    return {
        "n": units,
        "form": form,
        "prefix_chars": chars[p] - chars[offsets[:-1]],
        "middle_chars": chars[m] - chars[p],
        "output": pc.choose(pa.array(form, pa.int64()), plain, psm, spm),
    }


def restore(output: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts (binary) that outputs of the given forms were made from, by their sentinels alone."""
    raw, offsets = buffer_of(output)
    start, end = offsets[:-1], offsets[1:]

    def first(what: bytes) -> np.ndarray:
        """The first place in each row; the row's end where there is none."""
        at = np.append(occurrences(raw, offsets, what), len(raw))
        return np.minimum(at[np.searchsorted(at, start)], end)

    one, two, three = (first(x) for x in (PREFIX, SUFFIX, MIDDLE))
    # the sentinels in the order in which each form has them; a plain row is all first piece
    second = np.where(form == PSM, two, np.where(form == SPM, one, end))
    third = np.where(form == PLAIN, end, three)
    width = np.where(form == PLAIN, 0, len(PREFIX))
    bounds = start + width, second, np.minimum(second + width, end), third, np.minimum(third + width, end), end
    a, _, b, _, c = pieces(raw, *bounds)
    return pc.choose(pa.array(np.asarray(form), pa.int64()), a, joined(a, c, b), joined(b, c, a))


def fim_columns(cut: dict) -> list[pa.Array]:
    """The operator's own outputs."""
    form = cut["form"]
    spans = [pa.array(cut[c], pa.int64(), mask=form == PLAIN) for c in ("prefix_chars", "middle_chars")]
    return [pa.array(cut["n"], pa.int64()), pa.array(FORMS[form], pa.string()), *spans, cut["output"].cast(pa.large_string()).cast(pa.string())]


FIM_SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws_of(key: str) -> list[Column]:
    """h1 to h4 of a key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(df: DataFrame, key: str, text: str = "text", plain_from: int = 90, spm_below: int = 20, derive: Callable = fim_columns, schema: str = FIM_SCHEMA) -> DataFrame:
    """``key`` and the columns of ``schema``, which ``derive`` makes of what ``transform`` gives for a slice."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    rows = df.select(df[key].alias("key"), df[text].alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws_of(key))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            draws = np.stack([part.column(2 + i).to_numpy() for i in range(4)], 1)
            columns = derive(transform(part.column(1), draws, plain_from, spm_below))
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", *(f"c{i}" for i in range(len(columns)))])

    out = rows.mapInArrow(run, ", ".join([f"key {dict(df.dtypes)[key]}", *(f"c{i} {k}" for i, k in enumerate(kinds))]))
    return out.toDF(key, *names)
