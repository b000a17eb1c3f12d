"""The corpus pipeline: five stages over ``documents``, each an operator of ``plumbline.llm`` applied to all that the
stage before it kept.

1. Language ID: documents that the classifier rejects go.
2. MinHash near-dedup (five-word shingles, similarity 0.8): the smallest document of each group stays.
3. Substring dedup: words in passages of 13 words that a smaller document also has are removed; a document of which no
   word is left goes.
4. Mixing: sources take part by weight, 150 % of all words; a document that the mix takes twice is there twice, one of
   which it takes less than half goes. Documents lie in the shards that drew most of them, shuffled.
5. SentencePiece: the mix as token ids, with what they decode to.

Every row is a document, whatever its id. In stages 2 and 3 documents are in the order of their ids; those with the same
id in the order of a hash of their text, those without an id after all others.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, minhash, mixing, sentencepiece, substrings
from plumbline.llm.common import settled
from plumbline.llm.queries import PIECE_MODEL
from plumbline.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, "doc_id", "text", "lang")
    return langid.predict(docs, model).filter(~F.col("rejected")).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, unique and in the order of documents: the id itself where all have one of their own."""
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    return settled(ordered.withColumn("row", F.monotonically_increasing_id()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs)
    kept = minhash.near_duplicates(docs, "row", "text").filter("kept").select("row")
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs)
    cut = substrings.dedup_substrings(docs, "row", "text").filter("n_removed > 0").select("row", "n_words", "n_removed", "kept_text")
    both = docs.join(cut, "row", "left").filter("n_removed is null or n_removed < n_words")
    text = F.coalesce("kept_text", "text")
    return both.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text")).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.withColumn("size", mixing.word_count("text")), "doc_id", "source", "size")
    return mixing.shards_of(mixed, "size", least=0.5).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = sentencepiece.encode(docs, sentencepiece.load_model(PIECE_MODEL), "doc_id", "text")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mix_sources), ("sentencepiece", encode)]

#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
