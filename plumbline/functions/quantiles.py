"""Exact quantiles that no single task has to sort: a sketch brackets them, counts of cells narrow the bracket down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rank error of the sketch is 1 / ACCURACY; brackets reach MARGIN to both sides, or over everything up to SMALL values.
ACCURACY, MARGIN, SMALL = 10_000, 5e-4, 20_000
#: Cells that a bracket is counted in.
CELLS = 1024


def exact_quantiles(values: DataFrame, by: str, value: str, probabilities: list[float]) -> DataFrame:
    """``by, n, q`` (an array, in the order of ``probabilities``): quantiles with linear interpolation of the non-null
    values of each group.

    Three passes, of which only partial aggregates are shuffled: a mergeable sketch gives a bracket for each quantile,
    counts of the bracket's cells say in which its two ranks are, and the distinct values of that cell with their counts
    (about MARGIN / CELLS of the rows) say which they are.
    """
    rows = values.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null and g is not null")
    points = [x for p in probabilities for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketch = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), F.percentile_approx("v", points, ACCURACY).alias("s"))
    small = F.col("n") <= SMALL

    def bracket(i: int, p: float):
        rank = (F.col("n") - 1) * F.lit(float(p))
        return F.struct(F.lit(i).alias("i"), F.when(small, F.col("a")).otherwise(F.col("s")[2 * i]).alias("lo"), F.when(small, F.col("b")).otherwise(F.col("s")[2 * i + 1]).alias("hi"), F.floor(rank).alias("k"), (rank - F.floor(rank)).alias("f"))

    brackets = sketch.select("g", "n", F.explode(F.array(*(bracket(i, p) for i, p in enumerate(probabilities)))).alias("x")).select("g", "n", "x.*")
    inside = rows.join(F.broadcast(brackets), "g").filter("v <= hi")
    width = F.col("hi") - F.col("lo")
    cell = F.when(F.col("v") < F.col("lo"), -1).when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width * CELLS), F.lit(CELLS - 1))).otherwise(0).cast("long")
    counted = inside.withColumn("cell", cell).groupBy("g", "i", "n", "k", "f", "lo", "hi", "cell").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("g", "i").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("m"))
    last = F.least(F.col("k") + 1, F.col("n") - 1)
    chosen = counted.withColumn("before", F.sum("m").over(upto) - F.col("m")).filter(met(F.col("k")) | met(last)).drop("m")
    found = rows.join(F.broadcast(chosen), "g").filter((F.col("v") <= F.col("hi")) & (cell == F.col("cell"))).groupBy("g", "i", "n", "k", "f", "v").agg(F.count("*").alias("m"), F.min("before").alias("start"))
    # the cells of both ranks have nothing between them
    values_upto = Window.partitionBy("g", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("start", F.min("start").over(Window.partitionBy("g", "i"))).withColumn("before", F.col("start") + F.sum("m").over(values_upto) - F.col("m"))
    ends = placed.groupBy("g", "i", "n", "f").agg(F.max(F.when(met(F.col("k")), F.col("v"))).alias("x"), F.max(F.when(met(last), F.col("v"))).alias("y"))
    value_ = F.when((F.col("f") == 0) | (F.col("x") == F.col("y")), F.col("x")).otherwise(F.col("x") * (1 - F.col("f")) + F.col("y") * F.col("f"))
    return ends.groupBy(F.col("g").alias(by)).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", value_.alias("v")))), lambda s: s["v"]).alias("q"))


def quantile(df: DataFrame, value: str, probabilities: list[float], name: str = "q") -> DataFrame:
    """One row with the quantiles of a column as an array (null without values)."""
    found = exact_quantiles(df.select(F.lit(1).alias("all"), F.col(value).alias("v")), "all", "v", probabilities)
    return found.agg(F.first("q").alias(name))
