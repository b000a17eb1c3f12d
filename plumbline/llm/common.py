"""What several operators share: the shared scratch folder, Arrow slicing, words and their hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to a worker, which the executor and the worker both hold; Spark's own bound is 10,000
#: rows, whatever they weigh.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``; where that is unset a local one, which only a
    local master can use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def settled(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and reread: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.options(**options).parquet(path)
    delete_at_exit(spark, path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a ``settled`` frame that nothing still to be computed reads; the others go when the session
    ends."""
    spark, path = df.sparkSession, getattr(df, "_settled_at", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished plans: it does so when their handles are collected. The event queues
    hold on to the last plan until another event comes, so a tiny one is run first."""
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark._jvm.System.gc()


def delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` (string or binary) holds about ``most`` bytes; a longer value is alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
        give_back()


_LIBRARY = ctypes.CDLL(None)


def give_back() -> None:
    """Hands memory that arrays no longer need back to the system, Arrow's pool and the C library's where it can: workers
    live on between tasks, and what they keep is lost to the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBRARY, "malloc_trim"):
        _LIBRARY.malloc_trim(0)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; bytes.split() splits at just those six characters and
    bytes.lower() lowers A-Z alone."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


STEP = np.uint64(0x9E3779B97F4A7C15)


def fold64(x: np.ndarray) -> np.ndarray:
    """A shorter bijective scramble, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return x


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive words; none if there are fewer.

    Hashes of runs of 1, 2, 4, ... words are scrambled together from two of half the length, and those that ``n`` is the
    sum of are put one behind the other: no sum of powers, so that no pattern of words cancels out."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    power, size, out, span = hashes, 1, None, 0
    while True:
        if n & size:
            out = power if out is None else fold64(out[: len(power) - span] * STEP + power[span:])
            span += size
        if span == n:
            return mix64(out)
        power = fold64(power[:-size] * STEP + power[size:])
        size *= 2


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Keeps the first bytes of eight, by how many.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE_BYTES = 1 << 20


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of a text (those of ``words_of``): eight bytes of all words at a time are scrambled into
    what came before; long words have their XXH3."""
    raw = (text or "").encode()
    return _hashes_of(np.frombuffer(raw.lower() if lower else raw, np.uint8))


def joined_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ``word_hashes`` of several texts, one behind the other, and how many each has: a call a text costs more than the
    hashing."""
    encoded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join(encoded), np.uint8)
    begins = np.cumsum([0, *(len(x) + 1 for x in encoded)])
    space = np.append(True, SPACES[raw])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    return _hashes_of(raw), np.diff(np.searchsorted(starts, begins))


def _hashes_of(raw: np.ndarray) -> np.ndarray:
    if len(raw) <= PIECE_BYTES:
        return _piece_hashes(raw)
    space = np.append(np.flatnonzero(SPACES[raw]), len(raw))
    cuts = np.unique(space[np.minimum(np.searchsorted(space, np.arange(PIECE_BYTES, len(raw), PIECE_BYTES)), len(space) - 1)])
    return np.concatenate([_piece_hashes(x) for x in np.split(raw, cuts)])


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.empty(0, np.uint64)
    space = SPACES[raw]
    edges = np.flatnonzero(np.concatenate([[not space[0]], space[1:] != space[:-1], [not space[-1]]]))
    starts, left = edges[0::2], edges[1::2] - edges[0::2]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    long = np.flatnonzero(left > LONG_WORD)
    out = fold64(left.astype(np.uint64) * STEP ^ (eight[starts] & FIRST_BYTES[np.minimum(left, 8)]))
    on = np.flatnonzero((left > 8) & (left <= LONG_WORD))
    at, left, part = starts[on] + 8, left[on] - 8, out[on]
    while len(on):
        part = fold64(part * STEP ^ (eight[at] & FIRST_BYTES[np.minimum(left, 8)]))
        out[on] = part
        more = left > 8
        on, at, left, part = on[more], at[more] + 8, left[more] - 8, part[more]
    out = mix64(out)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : edges[2 * i + 1]])
    return out


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of a lower-cased text; fewer words count whole as one; no words,
    none."""
    hashes = word_hashes(text, lower=True)
    return np.unique(rolled(hashes, min(n, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Characters in a column: what sizes blocks of text."""
    return df.agg(F.coalesce(F.sum(F.length(column)), F.lit(0)).cast("long")).first()[0]


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of about ``BATCH_BYTES``, unless the session has a bound of its own. ``f`` sees all rows, and
    may not depend on where a batch ends."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)
