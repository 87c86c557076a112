"""Adapters between the shapes of multi-vector input.

* token rows: (doc_id, pos, v), one row a token;
* nested documents: (doc_id, vectors), one row a document, vectors in order of pos;
* Python: a list of two-dimensional arrays, or one three-dimensional array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nested(tokens: DataFrame, id_col: str = "doc_id", pos_col: str = "pos", vector_col: str = "v") -> DataFrame:
    """Token rows as nested documents; one shuffle by document."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(vector_col).alias("v"))))
    return tokens.groupBy(F.col(id_col).alias("doc_id")).agg(F.transform(ordered, lambda s: s["v"]).alias("vectors"))


def token_rows(documents: DataFrame) -> DataFrame:
    """Nested documents as token rows."""
    return documents.select("doc_id", F.posexplode("vectors").alias("pos", "v"))


def from_arrays(spark: SparkSession, arrays: Sequence | np.ndarray) -> DataFrame:
    """Nested documents from Python; ids are positions. A leading dimension of 1 is dropped from each array."""
    items = [np.asarray(a, np.float32) for a in arrays]
    items = [a[0] if a.ndim == 3 and a.shape[0] == 1 else a for a in items]
    if any(a.ndim != 2 for a in items):
        raise ValueError("every document or query must be a two-dimensional array (tokens, dim)")
    if len({a.shape[1] for a in items}) > 1:
        raise ValueError("all vectors must have the same dimension")
    table = pa.table(
        {"doc_id": pa.array(range(len(items)), pa.int64()), "vectors": pa.array([a.tolist() for a in items], pa.list_(pa.list_(pa.float32())))}
    )
    return spark.createDataFrame(table)


def as_documents(spark: SparkSession, documents) -> DataFrame:
    """Any accepted shape as nested documents (doc_id, vectors)."""
    if isinstance(documents, DataFrame):
        return documents.select("doc_id", "vectors") if "vectors" in documents.columns else nested(documents)
    return from_arrays(spark, documents)


def as_queries(spark: SparkSession, queries) -> DataFrame:
    """Any accepted shape as (query_id, vectors). Vectors of zeros are padding and are dropped."""
    if isinstance(queries, DataFrame):
        if "vectors" in queries.columns:
            found = queries.select("query_id", "vectors")
        else:
            found = nested(queries, "query_id", "qpos", "qv").withColumnRenamed("doc_id", "query_id")
    else:
        if isinstance(queries, np.ndarray) and queries.ndim == 2:
            queries = [queries]
        found = from_arrays(spark, queries).withColumnRenamed("doc_id", "query_id")
    return found.withColumn("vectors", F.filter("vectors", lambda v: F.exists(v, lambda x: x != 0)))


def query_rows(queries: DataFrame) -> DataFrame:
    """(query_id, vectors) as one row a query token: query_id, qpos, qv."""
    return queries.select("query_id", F.posexplode("vectors").alias("qpos", "qv"))
