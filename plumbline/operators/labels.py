"""Label statistics, factor summaries, bias between classes and factors."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_stats(items: DataFrame, targets: DataFrame, item: str, label: str) -> DataFrame:
    """One row: classes, labels, items, items without a label. ``targets`` holds a row a label."""
    found = targets.filter(F.col(label).isNotNull())
    one = found.agg(F.count_distinct(label).alias("class_count"), F.count("*").alias("label_count"), F.count_distinct(item).alias("labeled_items"))
    empty = items.select(item).distinct().join(found.select(item), item, "left_anti").agg(F.count("*").alias("empty_items"))
    return one.crossJoin(F.broadcast(empty))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def distribution(labels: DataFrame, classes: DataFrame, label: str, name: str) -> DataFrame:
    """Counts of all declared classes, absent ones at 0 and marked missing. ``classes``: label, name (a dimension)."""
    counts = label_counts(labels, label)
    return classes.join(counts, label, "left").select(F.coalesce(F.col(name), F.col(label).cast("string")).alias("class_name"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def imbalance(counts: DataFrame, positive_only: bool = False) -> DataFrame:
    """Ratio of the largest to the smallest count (one decimal); 0 if a class is empty, unless only positive ones
    count."""
    rows = counts.filter("n > 0") if positive_only else counts
    return rows.agg(F.round(F.coalesce(F.when(F.min("n") > 0, F.max("n") / F.min("n")), F.lit(0.0)), 1).alias("imbalance_ratio"))


def overlap(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Proportions of each class in two splits, the absolute difference of shared classes (4 decimals), and where it
    occurs."""
    sides = [label_counts(x, label).select(F.col(label).cast("string").alias("class_name"), F.col("n").alias(f"n_{s}"), (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(f"p_{s}")) for x, s in ((a, "a"), (b, "b"))]
    rows = sides[0].join(sides[1], "class_name", "full")
    where = F.when(F.col("n_a").isNull(), "b_only").when(F.col("n_b").isNull(), "a_only").otherwise("shared")
    return rows.select("class_name", where.alias("presence"), F.round(F.coalesce("p_a", F.lit(0.0)), 4).alias("p_a"), F.round(F.coalesce("p_b", F.lit(0.0)), 4).alias("p_b"), F.round(F.abs(F.col("p_a") - F.col("p_b")), 4).alias("diff"))


def parity(observed: DataFrame, expected: DataFrame, label: str) -> DataFrame:
    """Chi-squared statistic of the observed class counts against the expected shares, scaled to the observed total;
    classes that are not expected are left out. One row: statistic, degrees of freedom."""
    o = label_counts(observed, label).withColumnRenamed("n", "o")
    e = label_counts(expected, label).withColumnRenamed("n", "e")
    rows = e.join(o, label, "left").select(F.coalesce("o", F.lit(0)).alias("o"), "e")
    scaled = rows.select("o", (F.col("e") * F.sum("o").over(Window.partitionBy()) / F.sum("e").over(Window.partitionBy())).alias("e"))
    return scaled.agg(F.round(F.coalesce(F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")), F.lit(0.0)), 6).alias("chi2"), (F.greatest(F.count("*"), F.lit(1)) - 1).alias("dof"))


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution (regularised incomplete gamma, series or continued fraction)."""
    if dof <= 0 or x <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= z / n
            total += term
        return 1 - front * total
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def continuous_summary(df: DataFrame, factors: list[str]) -> DataFrame:
    """``factor, null_count, min, max, mean, std`` (sample) of numeric factors, in one pass."""
    cols = [e for f in factors for e in (F.count(F.when(F.col(f).isNull(), 1)).alias(f"n__{f}"), F.min(F.col(f).cast("double")).alias(f"a__{f}"), F.max(F.col(f).cast("double")).alias(f"b__{f}"), F.avg(f).alias(f"m__{f}"), F.stddev_samp(f).alias(f"s__{f}"))]
    rows = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f"n__{f}").alias("null_count"), F.col(f"a__{f}").alias("min"), F.col(f"b__{f}").alias("max"), F.round(f"m__{f}", 6).alias("mean"), F.round(f"s__{f}", 6).alias("std")) for f in factors))
    return df.agg(*cols).select(F.explode(rows).alias("r")).select("r.*")


def discrete_summary(df: DataFrame, factors: list[str], top: int = 10) -> DataFrame:
    """``factor, value, n, n_unique``: the commonest values; a null counts as a value."""
    long = df.select(*(F.col(f).cast("string").alias(f) for f in factors)).unpivot([], factors, "factor", "value")
    counts = long.groupBy("factor", "value").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("factor").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("n_unique", F.count("*").over(Window.partitionBy("factor"))).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= top).select("factor", "value", "n", "n_unique")


def pair_tables(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``x_name, y_name, x, y, n``: contingency tables of several pairs of columns, by one scan and one shuffle."""
    entries = F.array(*(F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs))
    return df.select(F.explode(entries).alias("e")).select("e.*").filter("x is not null and y is not null").groupBy("x_name", "y_name", "x", "y").agg(F.count("*").alias("n"))


def _nats(p: Column) -> Column:
    return -F.sum(p * F.log(p))


def mutual_information(tables: DataFrame) -> DataFrame:
    """``x_name, y_name, mi, hx, hy, nmi``: plug-in mutual information in nats, entropies, and MI over their mean."""
    both = Window.partitionBy("x_name", "y_name")
    t = tables.withColumn("p", F.col("n") / F.sum("n").over(both)).withColumn("px", F.sum("n").over(Window.partitionBy("x_name", "y_name", "x")) / F.sum("n").over(both)).withColumn("py", F.sum("n").over(Window.partitionBy("x_name", "y_name", "y")) / F.sum("n").over(both))
    out = t.groupBy("x_name", "y_name").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"), (-F.sum(F.col("p") * F.log("px"))).alias("hx"), (-F.sum(F.col("p") * F.log("py"))).alias("hy"))
    mean = (F.col("hx") + F.col("hy")) / 2
    r = lambda c, n: F.round(F.greatest(c, F.lit(0.0)) + 0.0, 6).alias(n)
    return out.select("x_name", "y_name", r(F.col("mi"), "mi"), r(F.col("hx"), "hx"), r(F.col("hy"), "hy"), r(F.when(mean > 0, F.col("mi") / mean).otherwise(F.lit(0.0)), "nmi"))


def adjusted_mi(table: list[tuple[str, str, int]]) -> float:
    """Adjusted mutual information of one contingency table (x, y, n): MI less its expectation under the two margins,
    over the mean entropy less the same."""
    rows, cols, n = {}, {}, sum(c for _, _, c in table)
    for x, y, c in table:
        rows[x] = rows.get(x, 0) + c
        cols[y] = cols.get(y, 0) + c
    h = lambda m: -sum(c / n * math.log(c / n) for c in m.values() if c)
    mi = sum(c / n * math.log(n * c / (rows[x] * cols[y])) for x, y, c in table if c)
    lg = math.lgamma
    expected = 0.0
    for a in rows.values():
        for b in cols.values():
            base = lg(a + 1) + lg(b + 1) + lg(n - a + 1) + lg(n - b + 1) - lg(n + 1)
            for k in range(max(1, a + b - n), min(a, b) + 1):
                expected += k / n * math.log(n * k / (a * b)) * math.exp(base - lg(k + 1) - lg(a - k + 1) - lg(b - k + 1) - lg(n - a - b + k + 1))
    mean = (h(rows) + h(cols)) / 2
    return 1.0 if abs(mean - expected) < 1e-15 else (mi - expected) / (mean - expected)


def adjusted_information(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``x_name, y_name, ami``: mutual information corrected for chance (Vinh et al. 2010), 0 for unrelated columns and 1
    for copies. Each pair's contingency table (classes x values, a dimension) is one group; rows are only counted."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        value = adjusted_mi(list(rows[["x", "y", "n"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"x_name": [rows["x_name"].iloc[0]], "y_name": [rows["y_name"].iloc[0]], "ami": [round(value, 6)]})

    return pair_tables(df, pairs).groupBy("x_name", "y_name").applyInPandas(run, "x_name string, y_name string, ami double")


def classwise_information(df: DataFrame, label: str, factors: list[str]) -> DataFrame:
    """``class_name, factor, mi``: mutual information of each factor with membership in each class."""
    tables = pair_tables(df, [(label, f) for f in factors])
    n = F.sum("n").over(Window.partitionBy("y_name"))
    t = tables.withColumn("n_all", n).withColumn("n_class", F.sum("n").over(Window.partitionBy("y_name", "x"))).withColumn("n_value", F.sum("n").over(Window.partitionBy("y_name", "y")))
    # the cell of the class, and the cell of all others, for each value; values that the class lacks have one cell
    term = lambda c, m: F.when(c > 0, c / F.col("n_all") * F.log(c * F.col("n_all") / (m * F.col("n_value")))).otherwise(F.lit(0.0))
    inside = t.groupBy("y_name", "x").agg(F.sum(term(F.col("n"), F.col("n_class")) + term(F.col("n_value") - F.col("n"), F.col("n_all") - F.col("n_class"))).alias("mi"), F.sum("n_value").alias("met"), F.first("n_all").alias("n_all"), F.first("n_class").alias("n_class"))
    rest = F.col("n_all") - F.col("met")  # rows whose value the class never has: all of them are of other classes
    lone = F.when((rest > 0) & (F.col("n_all") > F.col("n_class")), rest / F.col("n_all") * F.log(F.col("n_all") / (F.col("n_all") - F.col("n_class")))).otherwise(F.lit(0.0))
    return inside.select(F.col("x").alias("class_name"), F.col("y_name").alias("factor"), F.round(F.greatest(F.col("mi") + lone, F.lit(0.0)), 6).alias("mi"))


def diversity(df: DataFrame, factors: list[str], method: str = "simpson", by: str | None = None) -> DataFrame:
    """``factor, diversity`` (in each group of ``by``): evenness of a factor's values, 1 if all are as common, 0 if
    there is one value. simpson: (1/sum p^2 - 1)/(k - 1); shannon: entropy over log k."""
    if method not in ("simpson", "shannon"):
        raise ValueError(f"unknown diversity method {method!r}")
    keep = [F.col(by).cast("string").alias("group")] if by else [F.lit("all").alias("group")]
    long = df.select(*keep, *(F.col(f).cast("string").alias(f) for f in factors)).unpivot(["group"], factors, "factor", "value").filter("value is not null and group is not null")
    counts = long.groupBy("group", "factor", "value").agg(F.count("*").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("group", "factor")))
    out = p.groupBy("group", "factor").agg(F.count("*").alias("k"), F.sum(F.col("p") * F.col("p")).alias("s"), _nats(F.col("p")).alias("h"))
    value = (1 / F.col("s") - 1) / (F.col("k") - 1) if method == "simpson" else F.col("h") / F.log(F.col("k").cast("double"))
    out = out.select("group", "factor", F.round(F.when(F.col("k") > 1, value).otherwise(F.lit(0.0)), 6).alias("diversity"))
    return out if by else out.drop("group")


def metadata_gaps(df: DataFrame, label: str, factors: list[str], min_representation: int = 5) -> DataFrame:
    """Class and factor value pairs that are rarer than the factor's overall share lets expect.

    A gap: fewer than ``min_representation`` rows where more were expected; ``deficit`` is the missing share. Every class
    meets every value, from the margins: the grid is classes times values, both dimensions.
    """
    rows = df.filter(F.col(label).isNotNull())
    long = rows.select(F.col(label).cast("string").alias("class_name"), *(F.col(f).cast("string").alias(f) for f in factors)).unpivot(["class_name"], factors, "factor", "value").filter("value is not null")
    cells = long.groupBy("factor", "class_name", "value").agg(F.count("*").alias("actual"))
    values = cells.groupBy("factor", "value").agg(F.sum("actual").alias("n_value"))
    classes = label_counts(rows, label).select(F.col(label).cast("string").alias("class_name"), F.col("n").alias("n_class"))
    total = F.sum("n_class").over(Window.partitionBy())
    grid = values.crossJoin(F.broadcast(classes.withColumn("n_all", total)))
    full = grid.join(cells, ["factor", "class_name", "value"], "left").withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("expected", F.col("n_value") / F.col("n_all") * F.col("n_class"))
    gaps = full.filter((F.col("actual") < min_representation) & (F.col("expected") > min_representation))
    deficit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("actual") / F.col("expected")))
    return gaps.select("class_name", "factor", "value", "actual", F.round("expected", 1).alias("expected"), F.round(deficit, 3).alias("deficit"))
