"""A corpus pipeline: each stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mandi.llm import minhash, mixing, packing, quality, secrets
from mandi.llm.common import boxed, materialize, named, scratch, text_hash, unboxed


def with_length(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if they have that column, counted again from text (null text: null)."""
    if "n_chars" not in docs.columns:
        return docs
    return boxed(docs, text=F.col("text").cast("string")).select(*unboxed(docs.columns, n_chars=F.length("text").cast("long")))


def _in(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text are among rows (doc_id, text_hash): a doc_id may stand for several texts."""
    return docs.join(rows.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text")), docs.doc_id.eqNullSafe(F.col("of_id")) & (text_hash() == F.col("of_text")), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null or empty text goes.  Rows are judged by their text, language and source, whatever other rows of their
    doc_id are; of rows with one doc_id and text, which may differ in language or source, all stay if one is kept.
    """
    return _in(docs, quality.judge(docs).filter("kept").select("doc_id", "text_hash").distinct())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    A document is a doc_id with a text: rows that repeat both stay once, and different texts under one doc_id are
    different documents.  Rows without doc_id can't be told to be copies and stay, as do null and empty texts, which
    are like nothing.
    """
    one = _in(docs.filter("doc_id IS NOT NULL"), minhash.representatives(docs, k=5, num=80, den=100))
    rows = boxed(one, doc_id=F.col("doc_id"), text_hash=text_hash()).dropDuplicates(["doc_id", "text_hash"])
    return rows.select(*unboxed(docs.columns)).unionByName(docs.filter("doc_id IS NULL"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; every row stays, null and empty texts as they are."""
    return with_length(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix has them: some more than once, some not at all, a few in part.

    Texts without a word add nothing to the mix and go; a null source is a source.
    """
    return with_length(mixing.mix(docs).select(*map(named, docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, of every row; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing", mix_sources), ("packing", pack)]

# The tokenizer and the random draws have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  An empty table gives an empty result; columns beyond documents' own are carried along."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # what a stage writes on its way goes when its result is written
        with scratch(spark) as written:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            written.pop()
    return STAGES[-1][1](spark, docs, sf_dir)
