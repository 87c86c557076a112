"""K-means over token vectors: sampling, seeding, Lloyd steps.

Assignments and partial sums are one pass over the tokens; only one row a cluster and partition is
shuffled. Centroids are broadcast while they fit ``BROADCAST_BYTES``; beyond that tokens pass block
after block of centroids, carrying the best one so far.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import dense, vectors

BROADCAST_BYTES = 64 << 20


def sample_size(n_docs: int) -> int:
    """Documents that the codebook is trained on."""
    return min(1 + int(16 * math.sqrt(120 * n_docs)), n_docs)


def partition_count(n_docs: int, avg_tokens: float) -> int:
    """Centroids for a corpus: a power of two near 16 times the root of its tokens."""
    tokens = n_docs * avg_tokens
    return 2 ** int(math.floor(math.log2(16 * math.sqrt(tokens)))) if tokens > 0 else 1


def expanded_count(outliers: int, max_points: int = 256) -> int:
    """New centroids for so many outliers."""
    return max(1, 4 * math.ceil(outliers / max_points))


def shuffle_order(seed: int, *keys: str) -> list[Column]:
    """A reproducible random order: a seeded hash, ties by the keys themselves."""
    return [F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]]


def sample_rows(rows: DataFrame, n: int, total: int, seed: int, *keys: str) -> DataFrame:
    """About ``n`` of ``total`` rows, those whose seeded hash is low: no sort, no row moves, and the same rows each time."""
    if n >= total:
        return rows
    share = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return rows.filter(share < n / total)


def sample_documents(documents: DataFrame, n: int, total: int, seed: int = 42) -> DataFrame:
    return sample_rows(documents, n, total, seed, "doc_id")


def seeds(tokens: DataFrame, k: int, seed: int = 42, order: list[Column] | None = None) -> np.ndarray:
    """k distinct tokens as first centroids; an error if there are fewer."""
    order = order or shuffle_order(seed, "doc_id", "pos")
    rows = tokens.orderBy(*order).select("v").limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} centroids need as many tokens, found {len(rows)}")
    return np.array([r["v"] for r in rows], np.float64)


def _blocks(centroids: np.ndarray):
    rows = max(1, BROADCAST_BYTES // (8 * centroids.shape[1]))
    return [(k, centroids[k : k + rows]) for k in range(0, len(centroids), rows)]


def assign(tokens: DataFrame, centroids: np.ndarray, metric: str = "distance", code: str = "code", score: str | None = None) -> DataFrame:
    """``tokens`` with the nearest centroid's code, by squared distance or greatest dot product; ties to the lowest.

    ``score`` names a further column with the squared distance (or the dot product).
    """
    spark = tokens.sparkSession
    out = tokens.withColumn("_best", F.lit(None).cast("double")).withColumn("_code", F.lit(-1))
    for base, part in _blocks(centroids):
        shared = spark.sparkContext.broadcast(part)

        def work(batches, shared=shared, base=base):
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = batch.schema.names
                x = dense.vectors(batch.column(names.index("v")))
                if metric == "distance":
                    found, value = dense.argmin_distance(x, shared.value)
                    value = -value
                else:
                    found = dense.argmax_dot(x, shared.value)
                    value = (x * shared.value[found]).sum(1)
                before = np.asarray(batch.column(names.index("_best")).fill_null(-np.inf), np.float64)
                codes = np.asarray(batch.column(names.index("_code")), np.int32)
                better = value > before
                columns = dict(zip(names, batch.columns))
                columns["_best"] = pa.array(np.where(better, value, before))
                columns["_code"] = pa.array(np.where(better, found + base, codes).astype(np.int32))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

        out = out.mapInArrow(work, out.schema)
    best = -F.col("_best") if metric == "distance" else F.col("_best")
    extra = [best.alias(score)] if score else []
    return out.select(*tokens.columns, F.col("_code").alias(code), *extra)


def assign_sql(tokens: DataFrame, centroids: DataFrame, metric: str = "distance") -> DataFrame:
    """The same as a plan of joins and grouped maxima, for small codebooks and for comparison."""
    cost = vectors.squared_distance(F.col("v"), F.col("cv")) if metric == "distance" else -vectors.dot(F.col("v"), F.col("cv"))
    scored = tokens.join(F.broadcast(centroids)).withColumn("_cost", cost)
    keys = [c for c in tokens.columns if c != "v"]
    best = scored.groupBy(*keys).agg(F.min(F.struct("_cost", "code")).alias("_b"), F.first("v").alias("v"))
    return best.select(*tokens.columns, F.col("_b.code").alias("code"))


def cluster_sums(assigned: DataFrame, dim: int) -> DataFrame:
    """(code, n, s0, s1, ...): sums by cluster, added up in each batch before the shuffle."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = dense.vectors(batch.column(0)), np.asarray(batch.column(1))
            order = np.argsort(codes, kind="stable")
            found, first, n = np.unique(codes[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[order], first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64()), *[pa.array(sums[:, k]) for k in range(dim)]], ["code", "n", *[f"s{k}" for k in range(dim)]])

    schema = "code int, n long, " + ", ".join(f"s{k} double" for k in range(dim))
    parts = assigned.select("v", "code").mapInArrow(work, schema)
    return parts.groupBy("code").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(dim)])


def step(tokens: DataFrame, centroids: np.ndarray, seed: int = 42, turn: int = 0) -> np.ndarray:
    """One Lloyd step: means by cluster; a cluster without tokens becomes a token in seeded order."""
    dim = centroids.shape[1]
    sums = cluster_sums(assign(tokens, centroids), dim).toPandas()
    out = np.full_like(centroids, np.nan)
    out[sums["code"]] = sums[[f"s{k}" for k in range(dim)]].to_numpy(np.float64) / sums[["n"]].to_numpy(np.float64)
    empty = np.flatnonzero(np.isnan(out[:, 0]))
    if len(empty):
        rows = tokens.orderBy(*shuffle_order(seed + 1 + turn, "doc_id", "pos")).select("v").limit(len(empty)).collect()
        out[empty] = [rows[k % len(rows)]["v"] for k in range(len(empty))]
    return out


def train(tokens: DataFrame, k: int, iterations: int = 4, seed: int = 42, tolerance: float = 0.0, order: list[Column] | None = None) -> np.ndarray:
    """Centroids after at most ``iterations`` steps; stops when they move less than ``tolerance`` in all."""
    centroids = seeds(tokens, k, seed, order)
    for turn in range(iterations):
        moved = step(tokens, centroids, seed, turn)
        shift = float(np.sqrt(((moved - centroids) ** 2).sum(1)).sum())
        centroids = moved
        if shift < tolerance:
            break
    return centroids


def codebook(documents: DataFrame, iterations: int = 4, max_points: int = 256, n_samples: int | None = None, seed: int = 42, k: int | None = None, order: list[Column] | None = None) -> np.ndarray:
    """Unit centroids for nested documents, trained on a sample of them."""
    n_docs = documents.count()
    sample = sample_documents(documents, min(n_samples or sample_size(n_docs), n_docs), n_docs, seed)
    n, total = sample.agg(F.count("*"), F.coalesce(F.sum(F.size("vectors")), F.lit(0))).first()
    if not total:  # a sample of so few documents may be empty
        sample = documents
        n, total = sample.agg(F.count("*"), F.coalesce(F.sum(F.size("vectors")), F.lit(0))).first()
    if k is None:
        k = partition_count(n_docs, total / max(n, 1))
    k = max(1, min(k, total))
    tokens = sample.select("doc_id", F.posexplode("vectors").alias("pos", "v"))
    if total > k * max_points:
        tokens = sample_rows(tokens, k * max_points, total, seed + 1, "doc_id", "pos")
    tokens = tokens.persist()
    try:
        return dense.unit(train(tokens, min(k, tokens.count()), iterations, seed, order=order))
    finally:
        tokens.unpersist()
