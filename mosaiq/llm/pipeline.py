"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``docs``. ``run`` writes each stage's rows to the shared folder and reads them back for the next.

Edge cases are those of the operators: null, empty and blank texts have no language and go at the first
stage, as do texts in none of the known languages; a null source is a source of its own, and without a
column ``source`` there is no host evidence and all documents are one source; rows with null or repeated ids
are told apart by their texts; of equal or similar texts the row with the smallest id stays; very long
texts pass whole; extra columns of any name stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.plans.workspace import Workspace

from . import bpe, exact_dedup, language, minhash, mixing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; others go."""
    host = F.col("source") if "source" in docs.columns else None
    return language.keep_identified(docs, language.train(docs), host=host)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same normalised text, the one with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    if "source" in docs.columns:
        return mixing.mixed_documents(docs)
    return mixing.mixed_documents(docs.withColumn("source", F.lit(""))).drop("source")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a taken document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.token_digests(bpe.encode_documents(docs))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the language model, MinHash or BPE; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
