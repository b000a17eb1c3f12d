import math
import re
from collections import defaultdict

import pytest

from plumbline.llm import queries
from plumbline.llm.mixing import _hypergeometric, mix, shard_ends, shards_of, word_count


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets as the contract words it: again and again, what is above its limit is set to it and the rest reshared."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        out = fixed | {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = [s for s in rest if out[s] > most * sizes[s]]
        if not over:
            return out
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, docs):
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n or 0
    targets, taken = reshared(sizes), defaultdict(int)
    by = {k: (s, n or 0) for k, s, n in docs}
    for r in rows:
        s, n = by[r.doc_id]
        assert (r.size or 0, r.source_size) == (n, sizes[s]) and r.target == pytest.approx(targets[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * n and r.taken == sum(c.size for c in r.copies)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.5


def test_query_over_the_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.QUERIES["op4_mixing"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(queries.QUERIES["op4_mixing"](spark, sf_dir).collect(), key=lambda r: r.doc_id)


def test_nulls_ties_and_clashing_names(spark):
    docs = [(i, [None, "a", "b", "é", ""][i % 5], [None, 0, 3, 50, 7][i % 7 % 5]) for i in range(200)] + [(1000, "z", 0)]
    df = spark.createDataFrame([(k, s, n, "x", 3) for k, s, n in docs], "doc_id long, source string, size long, taken string, s int")
    rows = mix(df, "doc_id", "source", "size").collect()
    check(rows, docs)
    assert all(r.s == 3 for r in rows)
    assert mix(df.limit(0), "doc_id", "source", "size").count() == 0


def test_result_does_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id as doc_id", "cast(id % 3 as string) as source", "id % 40 as size")
    first = sorted(map(tuple, mix(df, "doc_id", "source", "size").select("doc_id", "taken").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert first == sorted(map(tuple, mix(df.repartition(7), "doc_id", "source", "size").select("doc_id", "taken").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_shards_share_the_quota_exactly(spark):
    quotas = {"a": 64_000, "b": 6_400, None: 128, "c": 0}
    ends = {r.source: r.ends for r in shard_ends(spark.createDataFrame(list(quotas.items()), "source string, quota long"), 8, 64, 1).collect()}
    for s, q in quotas.items():
        assert len(ends[s]) == 8 and ends[s][-1] == q // 64 and ends[s] == sorted(ends[s])
    runs = [sum(ends[s][i] - (ends[s][i - 1] if i else 0) for s in quotas) for i in range(8)]
    assert max(runs) - min(runs) <= 1
    df = spark.range(400).selectExpr("id as doc_id", "cast(id % 4 as string) as source", "cast(30 as bigint) as size")
    rows = shards_of(mix(df, "doc_id", "source", "size", shards=4, block=64), "size").collect()
    assert sum(r.taken for r in rows) == 18_000 and {r["shard"] for r in rows} == {0, 1, 2, 3}


def test_pieces_are_the_blocks_that_the_shards_drew(spark):
    """Against the tree: each shard holds its number of blocks of each source, no word is taken twice in a repeat."""
    block, shards = 50, 8
    df = spark.range(300).selectExpr("id as doc_id", "cast(id % 3 as string) as source", "(id * 37) % 211 as size")
    rows = mix(df, "doc_id", "source", "size", shards=shards, block=block, seed=3).collect()
    quotas = {r.source: round(r.target) for r in rows}
    ends = {r.source: r.ends for r in shard_ends(spark.createDataFrame(list(quotas.items()), "source string, quota long"), shards, block, 3).collect()}
    held = defaultdict(int)
    for r in rows:
        for j in {c.copy for c in r.copies}:
            mine = sorted((c.start, c.size) for c in r.copies if c.copy == j)
            assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and sum(n for _, n in mine) <= r.size
        for c in r.copies:
            held[r.source, c.shard] += c.size
    for s, q in quotas.items():
        short = -q % block  # the last block of the quota
        for i in range(shards):
            blocks = ends[s][i] - (ends[s][i - 1] if i else 0)
            assert held[s, i] in (blocks * block, blocks * block - short)
        assert sum(held[s, i] for i in range(shards)) == q


def test_shards_of_gives_whole_rows_by_share(spark):
    df = spark.range(100).selectExpr("id as doc_id", "'a' as source", "100 as size")
    mixed = mix(df, "doc_id", "source", "size", shards=4, block=64)
    rows = shards_of(mixed, "size", 0.5).collect()
    assert len(rows) == 150 and all(r.taken >= 50 for r in rows)
    assert shards_of(mixed.limit(0), "size").count() == 0


def test_hypergeometric_draws_follow_the_exact_distribution(spark):
    pool, marked, draws = 30, 11, 13
    rows = spark.range(20_000).selectExpr(f"{_hypergeometric(f'{pool}L', f'{marked}L', f'{draws}L', '((id + 0.5D) / 20000)')} as x").groupBy("x").count().collect()
    for r in rows:
        exact = math.comb(marked, r.x) * math.comb(pool - marked, draws - r.x) / math.comb(pool, draws)
        assert abs(r["count"] / 20_000 - exact) < 1e-3
    with pytest.raises(ValueError):
        mix(spark.range(1), "id", "id", "id", shards=3)


def test_word_count(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",), ("\x0b\x0c x y\t\n z ",)], "t string")
    assert [r.n for r in df.select(word_count("t").alias("n")).collect()] == [2, 0, 0, 2]
