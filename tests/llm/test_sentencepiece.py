import hashlib
import random

import numpy as np
import pytest
import sentencepiece as library

from plumbline.llm import queries
from plumbline.llm.sentencepiece import Encoder, decode, encode, load_model

RAW = library.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


@pytest.fixture(scope="module")
def model():
    return load_model(queries.PIECE_MODEL)


def texts():
    random.seed(3)
    letters = "abАé漢字 ▁\n\t  eeeethe<s>0x0A>😀\x00ñ,,.-"
    odd = ["", " ", "  a  b ", "a" * 5000, " " * 300, "the" * 500, "\n", "▁", "<s></s><unk>"]
    return odd + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(2000)]


def test_ids_and_texts_are_the_library_s(model):
    found = Encoder(model).encode(texts())
    expected = RAW.encode(texts(), add_eos=True)
    assert [x.tolist() for x in found] == expected
    assert [decode(model, x) for x in found] == RAW.decode(expected)


def test_any_ids_decode_as_in_the_library(model):
    random.seed(4)
    for _ in range(500):
        ids = [random.randrange(32000) if random.random() < 0.5 else random.randrange(260) for _ in range(random.randint(0, 12))]
        assert decode(model, np.array(ids, np.int32)) == RAW.decode(ids)
    with pytest.raises(ValueError):
        decode(model, np.array([32000], np.int32))


def test_operator_keeps_rows_and_handles_nulls(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "c", "x")], "doc_id long, text string, ids string")
    rows = encode(df, model, "doc_id").collect()
    assert len(rows) == 5 and {(r.doc_id, tuple(r.ids), r.decoded) for r in rows} == {(k, tuple(RAW.encode(t or "", add_eos=True)), t or "") for k, t in ((1, ""), (2, ""), (3, "a b"), (None, "c"))}
    assert encode(df.limit(0), model, "doc_id").count() == 0


def test_query_holds_over_the_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = RAW.encode(docs[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(RAW.decode(ids).encode()).hexdigest()


def test_a_model_that_normalizes_otherwise_is_refused(monkeypatch):
    class Other:
        """The library's model, as if it lower-cased."""

        def __init__(self, model_file):
            pass

        def __getattr__(self, name):
            return getattr(RAW, name)

        def encode(self, text, **options):
            return RAW.encode(text.lower(), **options)

    monkeypatch.setattr(library, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="normalizes"):
        load_model(queries.PIECE_MODEL)


def test_a_vocabulary_that_the_table_cannot_hold_is_refused(monkeypatch):
    monkeypatch.setattr("plumbline.llm.sentencepiece.SLOT_BITS", 10)
    with pytest.raises(ValueError, match="slots"):
        load_model(queries.PIECE_MODEL)
