"""What the vector operators share: which vectors count, and Arrow batches of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null nor zero nor holding null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sampled(df: DataFrame, vector: str, key: str, most: int, seed: int = 5) -> np.ndarray:
    """At most ``most`` vectors, those with the smallest hash of their key, as a matrix on the driver; the commonest
    length only."""
    rows = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(most).select(vector).collect()
    lengths = [len(r[0]) for r in rows]
    common = max(set(lengths), key=lengths.count) if rows else 0
    return np.array([r[0] for r in rows if len(r[0]) == common], np.float64).reshape(-1, common) if rows else np.zeros((0, 0))
