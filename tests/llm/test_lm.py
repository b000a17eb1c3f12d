import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm, queries
from plumbline.llm.lm import PRIOR, lm_scores


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, trains):
    """Scores by the formula, triple by triple."""
    one, two, three, follow = Counter(), Counter(), Counter(), Counter()
    split = [[*words(t), None] for _, t in rows]
    chained = lambda found: zip([None, "<start>", *found], ["<start>", *found], found)
    for found, train in zip(split, trains):
        if train:
            one.update(found)
            for i, (u, v, w) in enumerate(chained(found)):
                two[v, w] += 1
                follow[v] += 1
                three[u, v, w] += i > 0
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda v, w: (two[v, w] + PRIOR * p1(w)) / (follow[v] + PRIOR)
    out = []
    for (k, _), found, train in zip(rows, split, trains):
        base = sum(math.log10(p1(w)) for w in found)
        score = 0.0
        for i, (u, v_, w) in enumerate(chained(found)):
            seen = two[u, v_] if i > 0 else 0
            score += math.log10((three[u, v_, w] * (i > 0) + PRIOR * p2(v_, w)) / (seen + PRIOR))
        out.append((k, not train, len(found), sum(one[w] > 0 for w in found), n, base, score))
    return out


def same(found, expected):
    found, expected = (sorted(x, key=str) for x in (map(tuple, found), expected))
    assert [x[:5] for x in found] == [x[:5] for x in expected]
    for a, b in zip(found, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_query_over_the_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.QUERIES["op8_lm_scoring"](spark, sf_dir).collect()
    same(rows, brute(docs, [zlib.crc32(str(k).encode()) % 5 != 1 for k, _ in docs]))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("flush", [1_000_000, 30])
def test_odd_rows(spark, monkeypatch, flush):
    monkeypatch.setattr(lm, "FLUSH_TOKENS", flush)
    monkeypatch.setattr(lm, "RANGE_CHARS", 100 if flush == 30 else 3000)
    rows = [(1, None), (2, ""), (3, "A a\x0bA b"), (3, "A a\x0bA b"), (4, "unseen words only"), (None, "a b"), (6, "a " * 3000), (8, "é É a"), (10, "b a")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, block int, n long")
    trains = [k is None or k % 2 == 1 for k, _ in rows]
    same(lm_scores(df, F.coalesce(F.col("doc_id") % 2 == 1, F.lit(True))).collect(), brute(rows, trains))
    same(lm_scores(df, F.lit(False)).collect(), brute(rows, [False] * len(rows)))
    assert lm_scores(df.limit(0), F.lit(True)).count() == 0


def test_many_rows_of_one_key_are_spread(spark):
    rows = [(None, f"a b {i}") for i in range(60)] + [(5, f"b c {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(lm_scores(df, F.lit(True)).collect(), brute(rows, [True] * 120))


def test_packing_is_whole():
    rng = np.random.default_rng(1)
    for keys in (np.empty(0, np.uint64), np.array([0], np.uint64), np.array([2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**64, 999, dtype=np.uint64))):
        assert (lm.unpacked(lm.packed(keys)) == keys).all() and len(lm.unpacked(lm.packed(keys))) == len(keys)
    for counts in ([], [0], [1, 255, 256], [1 << 40, 3]):
        assert lm.from_planes(lm.planes(np.array(counts, np.int64))).tolist() == counts
