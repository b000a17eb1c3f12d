"""Orders that are the same on every run, and ranks that no single task has to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffled(key: str, seed: int) -> Column:
    """A hash of seed and key, as text: a random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def ranked(df: DataFrame, by: list[str], hashed: str, key: str, into: str = "rank") -> DataFrame:
    """Adds the rank (from 1) of each row of a group in the order of a hex hash, then key.

    In two levels: counts by the hash's first three digits, summed up before each, and ranks within; so a group of any
    size is spread over 4096 parts.
    """
    rows = df.withColumn("__part", F.substring(hashed, 1, 3))
    sizes = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(hashed, key)))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*by, "__part")]
    joined = inside.alias("l").join(offsets.alias("o"), same)
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("__r") + F.col("__before")).alias(into))


#: Parts that a numeric order is cut into.
PARTS = 64


def numbered(df: DataFrame, order: str, key: str, into: str, descending: bool = False) -> DataFrame:
    """Adds the position (from 1) in the order of a numeric column (nulls last), then key.

    In two levels: bounds of about equally many rows (a sketch over all rows; any bounds give the same result) deal the
    rows out, counts of the parts before each are added to the ranks within. Only rows of one value share a part by need.
    """
    value = F.col(order).cast("double")
    bounds = sorted(set(df.agg(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 10_000)).first()[0] or []))
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value))
    part = F.when(value.isNull(), F.lit(PARTS + 1)).otherwise(-part if descending else part)
    rows = df.withColumn("__part", part)
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = rows.groupBy("__part").agg(F.count("*").alias("__n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    inside = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(by, key)))
    return inside.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__r") + F.col("__before")).alias(into))


def renumbered(df: DataFrame, position: str, descending: bool = False, then: tuple[str, ...] = (), width: int = 1 << 20) -> DataFrame:
    """Replaces positions that have gaps (integers, whatever their order) by those from 0 without; ``then`` orders equal
    ones. Runs of ``width`` positions are parts, so no job is needed for bounds."""
    part = F.shiftright(F.col(position).cast("long"), width.bit_length() - 1)
    rows = df.withColumn("__part", -part if descending else part)
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = rows.groupBy("__part").agg(F.count("*").alias("__n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    by = F.col(position).desc() if descending else F.col(position).asc()
    inside = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(by, *then)) - 1)
    kept = [F.col(c) for c in df.columns if c != position]
    return inside.join(offsets, F.col("__part") == F.col("__p")).select(*kept, (F.col("__r") + F.col("__before")).cast("long").alias(position))
