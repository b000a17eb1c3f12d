import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from plumbline.llm import common, queries, substrings
from plumbline.llm.substrings import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    first, out = {}, []
    split = [(k, WORD.findall(t or "")) for k, t in rows]
    for k, words in split:
        for i in range(len(words) - n + 1 if k is not None else 0):
            w = tuple(words[i : i + n])
            first[w] = min(k, first.get(w, k))
    for k, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - n + 1 if k is not None else 0):
            if first[tuple(words[i : i + n])] < k:
                gone[i : i + n] = [True] * n
        out.append((k, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def test_query_over_the_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.QUERIES["op5_substring_dedup"](spark, sf_dir).collect()
    assert {tuple(r) for r in rows} == {(k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute(docs, 13)} and len(rows) == len(docs)


@pytest.mark.parametrize(("window", "shard"), [(13, 60_000), (4, 60_000), (6, 5), (13, 1)])
def test_random_texts_as_brute_force(spark, monkeypatch, window, shard):
    monkeypatch.setattr(substrings, "SHARD_PHRASES", shard)
    monkeypatch.setattr(substrings, "FLUSH_WINDOWS", 50)
    monkeypatch.setattr(substrings, "RANGE_CHARS", 1 << 20)
    random.seed(window)
    passages = [[random.choice("abcdefgh漢é") * random.randint(1, 2) for _ in range(40)] for _ in range(6)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(random.randint(0, 4)):
            p, a = random.choice(passages), random.randint(0, 25)
            words += p[a : a + random.randint(1, 30)] + [random.choice("xyz")] * random.randint(0, 3)
        rows.append((random.choice([k, k, 1000 - k]), random.choice([" ", "\n", "  "]).join(words)))
    rows += [(None, rows[3][1]), (None, None), (7777, None), (7778, ""), (7779, " \t"), rows[5], (3, " ".join(passages[0])), (4, " ".join(passages[0] * 30))]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, block int, w string")
    found = sorted(map(tuple, dedup_substrings(df, window=window).collect()), key=str)
    assert found == sorted(brute(rows, window), key=str)


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_automata_say_where_to_look(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, "x " + text), (3, text)], "doc_id long, text string").coalesce(1)
    assert sum(r.n_removed for r in dedup_substrings(df).collect()) == 80
    monkeypatch.setattr(substrings.Passages, "automata", lambda self: iter(()))
    keys, texts = [1, 2], [text.encode().split()] * 2
    assert not any(m.any() for m in substrings._marks(keys, texts, [text], [1], 13))


def test_windows_of_one_hash_are_told_apart_by_their_words(monkeypatch):
    monkeypatch.setattr(substrings.Passages, "_hashes", lambda self, words: np.zeros(max(0, len(words) - self.window + 1), np.uint64) + (words[: len(words) - self.window + 1] if self.seed > 2 else 0).astype(np.uint64) if self.seed > 2 else np.zeros(len(words) - self.window + 1, np.uint64))
    one, two = (" ".join(f"{c}{i}" for i in range(6)) for c in "ab")
    marks = substrings._marks([5, 6], [two.encode().split(), b"c d e f g h".split()], [one, two], [1, 2], 4)
    assert marks[0].all() and not marks[1].any()


def test_words_of_a_block_are_not_kept_as_objects():
    """Two million words come one text at a time; what is kept of them is a number and a mark each."""
    passage = " ".join(f"p{i}" for i in range(20))
    line = (passage + " " + "x y z " * 60_000).encode()
    tracemalloc.start()
    marks = substrings._marks(list(range(2, 13)), (line.split() for _ in range(11)), [passage], [1], 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(m.sum() == 20 and m[:20].all() for m in marks)
    assert peak < 60 << 20


def test_texts_are_hashed_together_as_each_alone(monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 3000)
    random.seed(5)
    texts = [None, "", " \t", "a", " b ", "x" * 70 + "\ny 漢é\x0bz", "p q r s t"] + [random.choice(" \n").join(random.choice(["a", "bcd", "longer-than-eight", "é" * 40, ""]) for _ in range(random.randint(0, 60))) for _ in range(50)]
    calls, piece = [], common._piece_hashes
    monkeypatch.setattr(common, "_piece_hashes", lambda raw: calls.append(1) or piece(raw))
    hashes, starts, own = substrings.windows_of(texts, 4)
    assert len(calls) < len(texts)
    alone = [common.word_hashes(t) for t in texts]
    assert hashes.tolist() == np.concatenate(alone).tolist()
    windows = [(n, w) for n, h in enumerate(alone) for w in common.rolled(h, 4).tolist()]
    assert list(zip(own.tolist(), common.rolled(hashes, 4)[starts].tolist())) == windows
    anchors = [a for h in alone for a in substrings.anchors_of(h, 4).tolist()]
    assert substrings.anchors_of(hashes, 4)[starts].tolist() == anchors


def test_short_texts_are_streamed_together_and_nothing_matches_across_them(monkeypatch):
    passage = [f"p{i}".encode() for i in range(30)]
    texts = [[b"x", *passage[:20], b"y"], passage[:6], passage[6:], [*passage[:12]], passage[12:], passage] * 50
    calls, earlier = [], substrings.Passages.earlier
    monkeypatch.setattr(substrings.Passages, "earlier", lambda self, words, starts, keys: calls.append(1) or earlier(self, words, starts, keys))
    marks = substrings._marks([*range(7, 306), 7], texts, [b" ".join(passage).decode()], [7], 13)
    assert len(calls) <= 2
    for n, mark in enumerate(marks):
        whole = 20 * (n % 6 == 0) + 24 * (n % 6 == 2) + 18 * (n % 6 == 4) + 30 * (n % 6 == 5)
        assert mark.sum() == (0 if n in (0, 299) else whole)
