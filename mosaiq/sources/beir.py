"""Retrieval data sets in the usual directory layout: corpus.jsonl, queries.jsonl, qrels/<split>.tsv."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.plans.workspace import Workspace, dense_names


def load(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, queries, qrels, document ids).

    documents (id, text: title and body), queries (query_id, text: only judged ones), qrels (query_id,
    query, doc_id, rel; positive judgements), document ids (position, id).
    """
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl")
    documents = corpus.select(F.col("_id").alias("id"), F.trim(F.concat_ws(" ", F.col("title"), F.col("text"))).alias("text"))
    judged = (
        spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int")
        .csv(f"{path}/qrels/{split}.tsv").filter("score > 0")
    )
    asked = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl")
    asked = asked.select(F.col("_id").alias("query_id"), F.col("text"))
    qrels = judged.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("rel"))
    queries = asked.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    qrels = qrels.join(queries.withColumnRenamed("text", "query"), "query_id").select("query_id", "query", "doc_id", "rel")
    positions = dense_names(Workspace(spark, "beir"), documents, ["id"], "ids", "position").select("position", "id")
    return documents, queries, qrels, positions
