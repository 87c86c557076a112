"""The inverted file: which documents have a token in a centroid's cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(encoded: DataFrame) -> DataFrame:
    """Distinct (code, doc_id); duplicates are dropped within each document's row, so nothing is shuffled."""
    return encoded.select(F.explode(F.array_distinct("codes")).alias("code"), "doc_id")


def lengths(ivf: DataFrame, n_centroids: int) -> DataFrame:
    """(code, length) for all centroids, empty cells included."""
    counts = ivf.groupBy("code").agg(F.count("*").alias("length"))
    every = ivf.sparkSession.range(n_centroids).select(F.col("id").cast("int").alias("code"))
    return every.join(counts, "code", "left").select("code", F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lists of appended documents joined to the existing ones; centroids that are new are kept."""
    return old.unionByName(new)


def stats(encoded: DataFrame) -> DataFrame:
    """One row: num_documents, num_embeddings, avg_doclen."""
    n = F.size("codes").cast("long")
    return encoded.agg(
        F.count("*").alias("num_documents"),
        F.coalesce(F.sum(n), F.lit(0)).alias("num_embeddings"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_doclen"),
    )
