"""A reference that a stream keeps up to date: a uniform sample of all rows so far, or the last ones by time.

Both are the ``size`` smallest rows in an order that each row carries: a hash of its key (``reservoir_sampling``) or its
time, the latest first (``last_seen``). What has left never comes back, so it is enough to hand on the rows that enter: the
reference is the smallest of them. Rows are dealt to parts by a hash of the key, and a part's state is the orders of its
own ``size`` smallest rows (16 bytes each), whatever the stream's length; it is kept in the query's checkpoint and survives
a restart. A sink that writes a batch twice does no harm, nor do rows that are read twice: a key counts once for each order.

Rows without a key are left out; those without a time are the oldest; rows of one time are in the order of the key's hash.
Late rows take the place that their time gives them, so the result doesn't depend on how a stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.ordering import numbered

STRATEGIES = ("last_seen", "reservoir_sampling")
#: Names without leading underscores, which a stateful processor would not get.
ORDER, TIE, PART = "order_", "tie_", "part_"
#: State variables of a processor need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OLDEST = (1 << 63) - 1


def ordered(df: DataFrame, key: str, strategy: str, time: str | None = None, seed: int = 0) -> DataFrame:
    """Rows with a key, and the order in which they are kept."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    if strategy == "last_seen" and time is None:
        raise ValueError("last_seen needs a column of times")
    at = F.xxhash64(F.lit(seed), F.col(key)) if time is None or strategy != "last_seen" else F.coalesce(-F.unix_micros(F.col(time).cast("timestamp")), F.lit(OLDEST))
    return df.filter(F.col(key).isNotNull()).withColumn(ORDER, at).withColumn(TIE, F.xxhash64(F.col(key)))


class Entrants(StatefulProcessor):
    """Hands on the rows that are among a part's ``size`` smallest when they come."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "orders binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = np.frombuffer(self.kept.get()[0] if self.kept.exists() else b"", np.int64).reshape(-1, 2)
        for batch in rows:
            both = np.concatenate([held, batch[[ORDER, TIE]].to_numpy(np.int64)])
            orders, first = np.unique(both, axis=0, return_index=True)
            entered = np.sort(first[: self.size][first[: self.size] >= len(held)]) - len(held)
            held = orders[: self.size]
            yield batch.iloc[entered].drop(columns=PART)
        self.kept.update((held.tobytes(),))

    def close(self) -> None:
        pass


def entering(stream: DataFrame, key: str, size: int, strategy: str = "reservoir_sampling", time: str | None = None, seed: int = 0, parts: int = 64) -> DataFrame:
    """The rows of a stream that enter its reference, as a stream to append to a table."""
    if size < 1:
        raise ValueError("size must be positive")
    stream.sparkSession.conf.set(*STORE)
    rows = ordered(stream, key, strategy, time, seed)
    dealt = rows.withColumn(PART, F.pmod(F.col(TIE), F.lit(parts)).cast("int"))
    return dealt.groupBy(PART).transformWithStateInPandas(Entrants(size), outputStructType=rows.schema, outputMode="Append", timeMode="None")


def current(entered: DataFrame, size: int) -> DataFrame:
    """The reference as the entered rows make it: a batch read of what ``entering`` wrote."""
    once = entered.dropDuplicates([ORDER, TIE])
    return numbered(once, ORDER, TIE, "__n").filter(F.col("__n") <= size).drop("__n", ORDER, TIE)


def updated(reference: DataFrame, batch: DataFrame, key: str, size: int, strategy: str = "reservoir_sampling", time: str | None = None, seed: int = 0) -> DataFrame:
    """The reference after a batch. Without ``time`` the last seen are those of the batch, the largest keys first, then
    those of the reference; keys are names within their side."""
    both = reference.withColumn("__side", F.lit(0)).unionByName(batch.withColumn("__side", F.lit(1)), allowMissingColumns=True).filter(F.col(key).isNotNull())
    if strategy == "last_seen" and time is None:
        rows = both.withColumn("__key", -F.col(key).cast("long"))
        late = rows.filter("__side = 1")
        n = late.count()
        kept = numbered(late, "__key", "__key", "__n").filter(F.col("__n") <= size)
        if n < size:
            kept = kept.unionByName(numbered(rows.filter("__side = 0"), "__key", "__key", "__n").filter(F.col("__n") <= size - n))
        return kept.drop("__n", "__key", "__side")
    named = ordered(both.withColumn("__key", F.concat_ws(":", "__side", F.col(key).cast("string"))), "__key", strategy, time, seed)
    return current(named, size).drop("__key", "__side")
