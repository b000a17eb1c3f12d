"""The thin queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, conversations, fim, gridjoin, html, langid, lm, minhash, mixing, oracles, quality, sentencepiece, substrings, warc
from plumbline.llm.common import delete_at_exit, scratch_dir, settled
from plumbline.session import table

QUERIES: dict = {}
ORACLES: dict = dict(oracles.ORACLES)

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(f):
    QUERIES[f.__name__] = f
    return f


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece.load_model(PIECE_MODEL)
    decimal = tuple(str(i).encode() for i in range(model.size))

    def digests(ids, decoded):
        joined = [b" ".join(map(decimal.__getitem__, row.tolist())) for row in ids]
        return [pa.array([len(row) for row in ids], pa.int64()), pa.array(map(sha, joined), pa.string()), pa.array([sha(t.encode()) for t in decoded], pa.string())]

    return sentencepiece.encode(table(spark, sf_dir, "documents"), model, "doc_id", derive=digests, schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    delete_at_exit(spark, path)
    records = warc.read(spark, path, payloads=False).filter("gap is null")
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = settled(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size")))
    return mixing.mix(sizes, "doc_id", "source", "size").select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 4, 2)
    model = langid.fit(docs.filter(~out), "doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text", out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", words=2, similarity=0.8)


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents"), "doc_id", "text", window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), ~langid.held_out("doc_id", 5, 1), "doc_id", "text")


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", least=0.93)


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id", "embedding", most=20)


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(cut):
        back = fim.restore(cut["output"], cut["form"])
        hashes = [pa.array([sha(x.as_buffer()) for x in column], pa.string()) for column in (cut["output"], back)]
        return [*fim.fim_columns(cut)[:4], *hashes]

    schema = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    return fim.fill_in_middle(table(spark, sf_dir, "documents"), "doc_id", "text", derive=digests, schema=schema)


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.Repair(rows, gone="gone").summaries()


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = langid.held_out("doc_id", 4, 2)
    model = quality.fit(docs.filter(~out), labels.filter(~out), "doc_id", "text", "quality")
    return quality.score(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
