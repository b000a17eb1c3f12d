"""Mixing sources to target weights, in DataFrame operations only.

Each source's rows, permuted by a hash of their key, make a stream of words (repeated as often as the quota asks for),
cut into blocks. A multivariate-hypergeometric splitting tree deals each source's quota of blocks out among the output
shards: at every node the left half's share of each source is drawn from the exact hypergeometric distribution (by
inverting its weights, conditional source by source), so every shard is a random draw of the whole mix and the shares add
up to the quota. A shard draws its number of blocks from the source's blocks in a permuted order, disjoint from the
others', and shuffles what it has locally by a hash. A row is taken in pieces, one for each block that it reaches into;
what no shard drew is not taken, so what a row gives follows from the tree.

The running size of the rows is found in two levels (hash ranges, then rows in a range), so no task sees a whole source.
The last block of a quota is as long as the quota leaves it, so taken sizes add up to the rounded target.

Defined results: null sizes count as 0; the null source is a source of its own, ordered last; a row of size 0 is never
taken; an empty table stays empty. Rows with equal keys are permuted by size. Columns named like an output are replaced.
The table of sources is collected in one task and its quotas in one row per node: it is a dimension, small beside the
rows, as the number of shards is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUTPUTS = ("source_size", "target", "taken", "copies")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size`` with ``target``: weights repeat in code-point order; targets stop at ``most`` times the
    source's size and the excess is shared again by weight until none is above.

    Sorted by the weight at which a source is full, the level that is reached is the largest of the levels left by
    filling all sources before each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = F.array(*(F.lit(float(w)) for w in weights))
    out = sizes.withColumn("weight", F.element_at(table, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    out = out.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    return out.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def _hypergeometric(pool: str, marked: str, draws: str, uniform: str) -> str:
    """SQL for how many of ``draws`` out of ``pool`` fall on the ``marked``: the inverse of the exact distribution at
    ``uniform``, over all values within 12 standard deviations of the mode."""
    mode = f"floor(({draws} + 1D) * ({marked} + 1D) / ({pool} + 2D))"
    spread = f"12 + 12 * sqrt({draws} * 1D * {marked} / greatest({pool}, 1) * (1D - {marked} * 1D / greatest({pool}, 1)) * greatest({pool} - {draws}, 0) / greatest({pool} - 1, 1))"
    low = f"cast(greatest(0, {draws} + {marked} - {pool}, {mode} - ceil({spread})) as bigint)"
    high = f"cast(least({marked}, {draws}, {mode} + ceil({spread})) as bigint)"
    following = f"s.w * ({marked} - k) * ({draws} - k) / ((k + 1D) * ({pool} - {marked} - {draws} + k + 1D))"
    total = f"aggregate(sequence({low}, {high}), named_struct('w', 1D, 't', 0D), (s, k) -> named_struct('w', {following}, 't', s.t + s.w), s -> s.t)"
    return f"least({high}, {low} + aggregate(sequence({low}, {high}), named_struct('w', 1D, 'c', 0D, 'n', 0L, 'goal', {uniform} * {total}), (s, k) -> named_struct('w', {following}, 'c', s.c + s.w, 'n', if(s.c + s.w < s.goal, s.n + 1, s.n), 'goal', s.goal), s -> s.n))"


def shard_ends(quotas: DataFrame, shards: int, block: int, seed: int) -> DataFrame:
    """``source, ends``: where in the permuted order of the source's blocks each shard's draw ends. ``quotas``: source,
    quota."""
    whole = quotas.select("source", F.ceil(F.col("quota") / F.lit(block)).cast("long").alias("blocks"))
    root = whole.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "blocks"))).alias("all"))
    nodes = root.select(F.lit(0).alias("node"), F.transform("all", lambda x: x["source"]).alias("sources"), F.transform("all", lambda x: x["blocks"]).alias("left"))
    for level in range(int(math.log2(shards))):
        # the state carries the pool, the draws left and the draws made: size(a.out) is the place of a source
        uniform = f"((shiftrightunsigned(xxhash64({seed}, {level}, node, size(a.out)), 11) + 0.5D) / 9007199254740992D)"
        draw = _hypergeometric("a.pool", "q", "a.draws", uniform)
        step = f"""aggregate(left, named_struct('pool', aggregate(left, 0L, (t, x) -> t + x), 'draws', aggregate(left, 0L, (t, x) -> t + x) div 2, 'out', cast(array() as array<bigint>)),
            (a, q) -> named_struct('pool', a.pool - q, 'draws', a.draws - {draw}, 'out', concat(a.out, array({draw}))), a -> a.out)"""
        split = nodes.select("node", "sources", "left", F.expr(step).alias("half"))
        nodes = split.select("sources", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("half").alias("left")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("left", "half", lambda a, b: a - b).alias("left")))).alias("n")).select("n.node", "sources", "n.left")
    rows = nodes.select("node", F.explode(F.arrays_zip("sources", "left")).alias("x")).select("node", F.col("x.sources").alias("source"), F.col("x.left").alias("blocks"))
    ends = rows.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "blocks"))), lambda x: x["blocks"]).alias("b"))
    running = F.aggregate("b", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))
    return ends.select("source", running.alias("ends"))


# Primes, one of which divides no number of blocks that a table can have.
PRIMES = (1_000_003, 999_983, 1_000_033, 1_000_037)


def mix(df: DataFrame, key: str, source: str, size: str, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 16, block: int = 1024, seed: int = 17) -> DataFrame:
    """Every row of ``df`` with its source's size and target, how much of it the mix takes (repeats counted), and
    ``copies``: the pieces taken, each with the repeat it belongs to, the shard that drew it, where in the row it starts,
    how much it holds, and the key that orders the shard."""
    if shards & (shards - 1) or shards < 1:
        raise ValueError("shards must be a power of two")
    rows = df.drop(*(c for c in OUTPUTS if c not in (key, source, size)))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(2, math.ceil(math.log2(4 * partitions)))
    rows = rows.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0))).withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))).withColumn("__h", F.xxhash64(F.lit(seed), F.col(key)))
    rows = rows.withColumn("__r", F.shiftrightunsigned(F.col("__h"), 64 - bits))
    ranges = rows.groupBy(F.col("__s").alias("s"), F.col("__r").alias("r")).agg(F.sum("__size").alias("n"), F.first(F.col(source)).alias("source"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_source = ranges.groupBy("s").agg(F.first("source").alias("source"), F.sum("n").alias("source_size"))
    targets = source_targets(per_source.select("source", "source_size"), weights, share, most).withColumn("quota", F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * F.lit(float(most)))))
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    ends = shard_ends(targets, shards, block, seed).select(named.alias("e"), "ends")
    targets = targets.select(named.alias("t"), F.col("source_size").alias("__total"), F.col("target").alias("__target"), "quota").join(ends, F.col("t") == F.col("e"))
    # block i of a source is the (i * step)th in its permuted order; a prime that doesn't divide their number reaches all
    step = F.coalesce(*(F.when(F.element_at("ends", -1) % prime != 0, F.lit(prime)) for prime in PRIMES), F.lit(1)).cast("long")
    placed = ranges.select("s", "r", "before").join(targets, F.col("s") == F.col("t")).select(F.col("s").alias("__ps"), F.col("r").alias("__pr"), F.col("before").alias("__before"), "__total", "__target", F.col("quota").alias("__quota"), F.col("ends").alias("__ends"), F.element_at("ends", -1).alias("__blocks"), step.alias("__step"))
    inside = Window.partitionBy("__s", "__r").orderBy(F.expr("shiftrightunsigned(__h, 1)"), "__h", F.col(key), "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__at", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    rows = rows.join(placed, (F.col("__s") == F.col("__ps")) & (F.col("__r") == F.col("__pr"))).withColumn("__at", F.col("__at") + F.col("__before"))
    low, high = "(__at + j * __total)", "least(__at + j * __total + __size, __quota)"
    piece = f"""named_struct('copy', cast(j as int), 'shard', cast(size(filter(__ends, x -> x <= (b * __step) % __blocks)) as int), 'start', greatest(b * {block} - {low}, 0L),
        'size', least((b + 1) * {block}, {high}) - greatest(b * {block}, {low}), 'shuffle_key', xxhash64({seed + 1}, __h, j, b))"""
    pieces = F.expr(f"""filter(flatten(transform(sequence(0L, cast(ceil({float(most)}D) as bigint) - 1), j -> if({high} > {low},
        transform(sequence({low} div {block}, ({high} - 1) div {block}), b -> {piece}), array()))), c -> c.shard < {shards})""")
    out = rows.withColumn("__copies", pieces)
    columns = [F.col(c) for c in df.columns if c not in OUTPUTS or c in (key, source, size)]
    return out.select(*columns, F.col("__total").alias("source_size"), F.col("__target").alias("target"), F.expr("aggregate(__copies, 0L, (t, c) -> t + c.size)").alias("taken"), F.col("__copies").alias("copies"))


def shards_of(mixed: DataFrame, size: str, least: float = 0.0, partitions: int | None = None) -> DataFrame:
    """The rows of a mix, whole, once for each repeat of which it takes more than ``least`` of the row, in ``shard`` (that
    which drew most of the repeat) with how much was taken. Shards are dealt to tasks in parts and shuffled there by the
    hash, so a shard of any size is no single task."""
    columns = [c for c in mixed.columns if c not in OUTPUTS]
    repeat = """aggregate(filter(copies, c -> c.copy = j), named_struct('n', 0L, 'most', -1L, 'shard', 0, 'shuffle_key', 0L),
        (a, c) -> named_struct('n', a.n + c.size, 'most', greatest(a.most, c.size), 'shard', if(c.size > a.most, c.shard, a.shard), 'shuffle_key', if(c.size > a.most, c.shuffle_key, a.shuffle_key)))"""
    repeats = F.expr(f"filter(transform(array_distinct(transform(copies, c -> c.copy)), j -> {repeat}), r -> r.n > 0 and r.n >= {float(least)}D * `{size}`)")
    rows = mixed.select(*columns, F.explode(repeats).alias("copy")).select(*columns, "copy.shard", F.col("copy.n").alias("taken"), F.col("copy.shuffle_key").alias("shuffle_key"))
    count = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, F.col("shard"), F.pmod("shuffle_key", F.lit(count))).sortWithinPartitions("shard", "shuffle_key")
