"""A training-data pipeline over ``documents``: classify, dedup exactly and nearly, redact secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages a result is written as Parquet and read
again.  All but the last return the columns of ``documents``.
"""
from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import exact_dedup as exact
from galley.llm import packing, quality_model, secret_scan, simhash
from galley.llm.common import ROW, new_path, numbered, owned
from galley.llm.vocabulary import Vocabulary


def _stage(f):
    """What a stage writes for itself goes when the next one over the same folder begins: its result has been written by then."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with owned(spark, f"pipeline {sf_dir}"):
            return f(spark, docs, sf_dir)

    return run_stage


def _chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` (from ``numbered``) that ``rows`` names; a verdict on one row says nothing of others with its identifier."""
    key = list(ROW[1:])
    return docs.join(rows.select(*key), key, "left_semi").drop(*ROW)


def _one_each(found: DataFrame, group: str) -> DataFrame:
    """One row of each group: the first by content, then by place, so that only equal rows are left to chance."""
    return found.groupBy(group).agg(F.min(F.struct(*ROW)).alias("r")).select("r.*")


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects.

    Verdicts of this and the next two stages are on rows: equal and null identifiers don't matter, every row is judged
    by its own text (null as empty), and other columns pass as they are.  An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = numbered(docs)
    judged = quality_model.classify(docs, labels, carry=ROW)
    return _chosen(docs, judged.where("predicted = 1"))


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts (null and empty ones are a group), the one with the smallest identifier.

    A null identifier comes last; of rows that agree in text and identifier the first by content, then by place stays.
    """
    docs = numbered(docs)
    found = exact.exact_dedup(docs, keep="smallest", carry=ROW)
    return _chosen(docs, _one_each(found.where("kept"), "text_sha256"))


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest identifier; ties and nulls as above."""
    docs = numbered(docs)
    found = simhash.similar_documents(docs, ngram=5, similarity=0.8, carry=ROW)
    return _chosen(docs, _one_each(found.where("doc_id <=> component_id"), "component"))


@_stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact secrets that look live; n_chars follows the text. Every row stays, null texts stay null."""
    clean = secret_scan.redact(docs, secret_scan.secret_scan(docs, owner=F.col("source")))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; a row a piece. A null or empty text is the end id alone."""
    packed = packing.pack(docs, Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", near_stage), ("secret scans", secrets_stage), ("best-fit packing", packing_stage)]

#: SQL can't express the classifier, fingerprints or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
