"""Changes to an index: appending, outliers and new centroids, thresholds, deletion with renumbering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import dense
from mosaiq.plans.workspace import Workspace, dense_names

from . import kmeans


def distances(tokens: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``tokens`` with ``dist``, the squared distance to the nearest centroid."""
    return kmeans.assign(tokens, centroids, "distance", "_c", "dist").drop("_c")


def outliers(tokens: DataFrame, centroids: np.ndarray, threshold: float) -> DataFrame:
    """Tokens farther than ``threshold`` from every centroid; a difference below 1e-9 is none."""
    return distances(tokens, centroids).filter(F.round("dist", 9) > round(threshold * threshold, 9))


def expand(tokens: DataFrame, centroids: np.ndarray, threshold: float, iterations: int = 4, max_points: int = 256, seed: int = 42, order=None) -> np.ndarray:
    """``centroids`` followed by new ones for the outliers among ``tokens``; existing codes stay valid."""
    far = outliers(tokens, centroids, threshold).select("doc_id", "pos", "v").persist()
    try:
        n = far.count()
        if not n:
            return centroids
        k = min(kmeans.expanded_count(n, max_points), n)
        return np.concatenate([centroids, dense.unit(kmeans.train(far, k, iterations, seed, order=order))])
    finally:
        far.unpersist()


def merge_thresholds(old: float, n_old: int, new: float, n_new: int) -> float:
    """The mean of two thresholds, weighted by their tokens."""
    total = n_old + n_new
    return (old * n_old + new * n_new) / total if total else old


def renumber(ws: Workspace, ids: DataFrame, deleted: DataFrame, table: str = "renumber") -> DataFrame:
    """(doc_id, new_id) of the documents that stay, numbered without gaps in their order.

    No window over all rows: ids are range-partitioned and each partition adds the rows before it.
    """
    stay = ids.select("doc_id").join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")
    return dense_names(ws, stay, ["doc_id"], table, "new_id")


def apply_numbers(rows: DataFrame, numbers: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of documents that stay, under their new numbers."""
    mapping = numbers.select(F.col("doc_id").alias("_old"), F.col("new_id").alias("_new"))
    return rows.join(mapping, F.col(column) == F.col("_old")).withColumn(column, F.col("_new")).drop("_old", "_new")
