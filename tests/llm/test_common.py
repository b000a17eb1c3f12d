import os
import random
import re

import numpy as np
import pyarrow as pa

from plumbline.llm import common
from plumbline.llm.common import rolled, word_hashes, words_of


def test_words_split_at_six_characters_only():
    random.seed(1)
    for _ in range(300):
        text = "".join(random.choice("aB é漢\t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　") for _ in range(30))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert [w.decode() for w in words_of(text)] == words
        assert len(word_hashes(text)) == len(words)


def test_hashes_name_words(monkeypatch):
    random.seed(2)
    text = " ".join("".join(random.choice("abcdeé") for _ in range(random.randint(1, 6))) for _ in range(4000))
    words, hashes = words_of(text), word_hashes(text)
    assert len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist())))
    assert np.array_equal(word_hashes(text.upper(), lower=True), word_hashes(text.upper().encode().lower().decode()))
    monkeypatch.setattr(common, "PIECE_BYTES", 50)
    assert np.array_equal(hashes, word_hashes(text))
    assert len(word_hashes("x" * 500 + " y")) == 2


def thue_morse(n, letters=("a", "b")):
    """A word and its complement, which sums of powers modulo a power of two can't tell apart from some length on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return ["".join(letters[b ^ flip] for b in bits) for flip in (0, 1)]


def test_words_and_runs_that_sums_of_powers_confuse_are_told_apart():
    for n in (8, 64, 512, 1024, 2048, 4096):
        one, two = thue_morse(n)
        assert word_hashes(one)[0] != word_hashes(two)[0]
        assert rolled(word_hashes(" ".join(one)), n)[0] != rolled(word_hashes(" ".join(two)), n)[0]
    sizes = ["x" * k for k in range(1, 200)] + ["x" * k + "y" for k in range(200)]
    assert len(set(word_hashes(" ".join(sizes)).tolist())) == len(set(sizes))


def test_rolled_is_one_hash_a_run():
    random.seed(6)
    hashes = word_hashes(" ".join(random.choice("abc") for _ in range(3000)))
    for n in (1, 2, 3, 5, 7, 13, 16, 50):
        runs = [tuple(hashes[i : i + n].tolist()) for i in range(len(hashes) - n + 1)]
        found = rolled(hashes, n)
        assert len(found) == len(runs) and len(set(found.tolist())) == len(set(runs)) == len(set(zip(runs, found.tolist())))
        assert np.array_equal(rolled(hashes[5 : 5 + n], n), found[5:6])


def test_rolled_names_runs():
    hashes = word_hashes("a b a b a c b a")
    assert len(set(rolled(hashes, 2).tolist())) == 4
    assert rolled(hashes, 2)[0] == rolled(hashes, 2)[2] and len(rolled(hashes, 9)) == 0


def test_a_discarded_table_is_gone(spark):
    df = common.settled(spark.range(5))
    path = df._settled_at
    assert df.count() == 5 and os.path.exists(path)
    common.discard(df)
    common.discard(spark.range(3))  # never settled: nothing to delete
    assert not os.path.exists(path)


def test_batches_for_workers_are_bounded_by_bytes(spark):
    """Rows of 100 kB: Spark's bound of 10,000 rows would send all 20 MB at once."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    df = spark.range(0, 200, 1, 1).selectExpr("id", "repeat('x', 100000) as t")
    before = spark.conf.get(common.BATCH_SETTING, None)
    try:
        spark.conf.unset(common.BATCH_SETTING)
        found = common.arrow_map(df, run, "rows long, bytes long").collect()
        assert sum(r.rows for r in found) == 200
        assert max(r.bytes for r in found) <= common.BATCH_BYTES + 200_000
        spark.conf.set(common.BATCH_SETTING, str(8 << 20))  # a session's own bound stays
        assert max(r.bytes for r in common.arrow_map(df, run, "rows long, bytes long").collect()) > common.BATCH_BYTES + 200_000
    finally:
        spark.conf.unset(common.BATCH_SETTING) if before is None else spark.conf.set(common.BATCH_SETTING, before)
