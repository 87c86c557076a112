"""Queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, exact_dedup, language, lines, media, minhash, mixing, pii, pipeline, sql, suffix, toxicity
from .common import read_documents


def op1_media(spark, sf_dir):
    return media.media_features(read_documents(spark, sf_dir))


def op2_mixing(spark, sf_dir):
    mixed = mixing.mix(read_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_suffix(spark, sf_dir):
    return suffix.span_digests(suffix.remove_repeats(read_documents(spark, sf_dir)))


def op4_bpe(spark, sf_dir):
    return bpe.token_digests(bpe.encode_documents(read_documents(spark, sf_dir)))


def op5_minhash(spark, sf_dir):
    return minhash.near_duplicates(read_documents(spark, sf_dir))


def op6_toxicity(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        toxicity.is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op7_language(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    return language.identify(docs, language.train(docs), host=F.col("source"))


def language_of_pages(spark, sf_dir):
    """The same operator where markup and addresses exist: web pages, with text models from documents."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, domain, suffix = language.host_levels(F.col("url"))
    bare = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1)
    model = language.train(read_documents(spark, sf_dir))
    return language.identify(
        pages.withColumn("text", bare), model, id_col="page_id", host=host, domain=domain, suffix=suffix, declared=declared
    )


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(read_documents(spark, sf_dir))


def op9_lines(spark, sf_dir):
    return lines.line_digests(lines.remove_lines(read_documents(spark, sf_dir)))


def op10_pii(spark, sf_dir):
    return pii.span_digests(pii.find_personal_data(read_documents(spark, sf_dir)))


def queries():
    return {
        "op1_media": op1_media,
        "op2_mixing": op2_mixing,
        "op3_suffix": op3_suffix,
        "op4_bpe": op4_bpe,
        "op5_minhash": op5_minhash,
        "op6_toxicity": op6_toxicity,
        "op7_language": op7_language,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_lines": op9_lines,
        "op10_pii": op10_pii,
        "language_of_pages": language_of_pages,
        "pipeline": pipeline.run,
    }


def oracle_sql():
    return {"op2_mixing": sql.MIXING, "op8_exact_dedup": sql.EXACT_DEDUP}
