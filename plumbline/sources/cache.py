"""Intermediate tables kept as Parquet under a key of their lineage; only missing columns are computed again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VERSION = "v1"


def lineage_key(fingerprint: str, *steps: object) -> str:
    return hashlib.sha256(json.dumps([fingerprint, *steps], sort_keys=True, default=str).encode()).hexdigest()[:32]


class TableCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{VERSION}"

    def _path(self, key: str, name: str) -> str:
        return f"{self.root}/{key}/{name}"

    def has(self, key: str, name: str) -> bool:
        """Whether a whole table is there: writers commit it with a marker."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(key, name) + "/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def table(self, key: str, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        if not self.has(key, name):
            compute().write.mode("overwrite").parquet(self._path(key, name))
        return self.spark.read.parquet(self._path(key, name))

    def metrics(self, key: str, index: str, names: list[str], compute: Callable[[list[str]], DataFrame]) -> DataFrame:
        """``index`` and the named metric columns; those not kept yet are computed together and kept a table each."""
        missing = [n for n in names if not self.has(key, f"metric={n}")]
        if missing:
            fresh = compute(missing).persist()
            for n in missing:
                fresh.select(index, n).write.mode("overwrite").parquet(self._path(key, f"metric={n}"))
            fresh.unpersist()
        out = self.spark.read.parquet(self._path(key, f"metric={names[0]}"))
        for n in names[1:]:
            out = out.join(self.spark.read.parquet(self._path(key, f"metric={n}")), index)
        return out
