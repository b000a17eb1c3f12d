import random
import re

import numpy as np
import pytest

from plumbline.llm import minhash, queries
from plumbline.llm.graph import components
from plumbline.llm.minhash import near_duplicates


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(docs, n, percent=80):
    sets = {k: shingles(t, n) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(k, len(sets[k]), find(k), find(k) == k) for k in keys}


def test_query_links_as_brute_force_does(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_minhash"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and {tuple(r) for r in rows} == brute(docs, 2)


@pytest.mark.parametrize("members", [512, 4])
def test_families_buckets_and_blocks_lose_no_link(spark, monkeypatch, members):
    monkeypatch.setattr(minhash, "BUCKET_MEMBERS", members)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs, k = {}, 0
    for _ in range(12):
        base = random.choices(vocabulary, k=random.choice([6, 30, 120, 400]))
        for _ in range(12):
            words = [w if random.random() > 0.04 else random.choice(vocabulary) for w in base]
            docs[k := k + 1] = " ".join(words)
    docs |= {900: "", 901: None, 902: "one", 903: "ONE", 904: " \t\n", 905: docs[1].upper(), 906: docs[1]}
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in docs.items()], "doc_id long, text string, n long, c string")
    assert {tuple(r) for r in near_duplicates(df, words=2).collect()} == brute(docs, 2)


def test_null_keys_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (7, "a b c"), (None, "z")], "doc_id long, text string")
    rows = near_duplicates(df, words=2).collect()
    assert sorted((tuple(r) for r in rows), key=str) == sorted([(None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (7, 2, 4, False), (None, 1, None, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (200, 200)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_intersections_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    found = minhash.intersections(sets[:4], sets[4:])
    assert [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]] == found.astype(int).tolist()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for size in (5, 40, 500):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        b = np.concatenate([a[: int(size * 0.8)], rng.integers(0, 1 << 62, size - int(size * 0.8)).astype(np.uint64)])
        b = np.unique(b)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.25


def test_large_groups_by_pivot_and_rest(spark, monkeypatch):
    """A chain: no member is linked with all, the pivot with few."""
    monkeypatch.setattr(minhash, "BUCKET_MEMBERS", 5)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 6)
    words = [f"v{i}" for i in range(400)]
    docs = {i: " ".join(words[i * 4 : i * 4 + 100]) for i in range(70)} | {500 + i: " ".join([*words[:99], f"x{i}"]) for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {tuple(r) for r in near_duplicates(df, words=2).collect()}
    assert found == brute(docs, 2) and {c for _, _, c, _ in found} == {0}


def test_sizes_travel_with_sketches(spark):
    df = spark.createDataFrame([(1,), (77_000,), (1 << 40,)], "n long")
    assert [np.frombuffer(r[0], ">i8")[0] for r in df.select(minhash.size_bytes()).collect()] == [1, 77_000, 1 << 40]


def test_a_very_long_text(spark):
    words = [f"w{i % 50_021}x{i % 7}" for i in range(300_000)]
    df = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(words[:270_000])), (3, " ".join(words[:100_000]))], "doc_id long, text string")
    assert [tuple(r)[2:] for r in near_duplicates(df).orderBy("doc_id").collect()] == [(1, True), (1, False), (3, True)]
