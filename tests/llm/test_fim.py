import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import queries
from plumbline.llm.fim import FORMS, fill_in_middle, restore, transform


def by_hand(key, text):
    """The definition, a row at a time with regular expressions."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts(n, seed=5):
    random.seed(seed)
    letters = "abZ é漢😀<>PSM\n\t .1́"
    odd = [None, "", "a", "é", "<P>", "<", "<S", "x<M>y", "<P", ">", "a" * 3000, "1" * 500, "é" * 500, "<<P>S>", "P>", "<S>"]
    return odd + ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(n)]


def test_equals_the_definition(spark):
    rows = list(enumerate(texts(3000)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: tuple(r)[1:] for r in fill_in_middle(df, "doc_id").collect()}
    assert found == {k: by_hand(k, t) for k, t in rows}
    assert {f[1] for f in found.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", [0, 1, 400])
def test_outputs_give_the_texts_back(size):
    """Whatever is cut where, also in slices of a batch that have an offset."""
    given = texts(500)[:size]
    column = pa.array(given, pa.string())
    draws = np.random.default_rng(size).integers(0, 1 << 32, (len(given), 4))
    for lo in (0, min(3, size)):
        cut = transform(column.slice(lo), draws[lo:], 90, 50)
        back = restore(cut["output"], cut["form"])
        assert [b.decode() for b in back.to_pylist()] == [t or "" for t in given[lo:]]
        assert set(FORMS[cut["form"]]) <= {"plain", "psm", "spm"}


def test_neighbours_in_a_batch_do_not_touch():
    """Letters, sentinels and cuts end with their row."""
    column = pa.array(["ab", "cd", "<P", ">x", "", "ef"])
    cut = transform(column, np.zeros((6, 4), np.int64), 90, 0)
    assert cut["n"].tolist() == [1, 1, 2, 2, 0, 1]
    assert FORMS[cut["form"]].tolist() == ["psm", "psm", "psm", "psm", "plain", "psm"]
    assert cut["output"].to_pylist()[:4] == [b"<P><S>ab<M>", b"<P><S>cd<M>", b"<P><S><P<M>", b"<P><S>>x<M>"]
    assert restore(cut["output"], cut["form"]).to_pylist() == [b"ab", b"cd", b"<P", b">x", b"", b"ef"]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, None, "x"), (2, "x y z", "u"), (2, "x y z", "u"), (3, "é" * 300_000 + " a", "v")], "doc_id long, text string, n string")
    rows = fill_in_middle(df, "doc_id").collect()
    assert len(rows) == 5 and sorted(map(str, (tuple(r) for r in rows if r.doc_id is not None))) == sorted(str((r.doc_id, *by_hand(r.doc_id, r.text))) for r in df.collect() if r.doc_id is not None)
    assert [tuple(r)[1:] for r in rows if r.doc_id is None] == [by_hand(None, "a b")]
    empty = fill_in_middle(df.limit(0), "doc_id")
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_query_holds_over_the_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_fill_in_middle"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, p, m, output = by_hand(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
