"""Connected components of a table of edges, by alternating large and small stars.

Every step is a grouped minimum and a join on node ids. Nothing is collected; a node with very many
edges is pre-aggregated before the shuffle, and its join can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.workspace import Workspace


def _star(edges: DataFrame) -> DataFrame:
    """From (u, v): each v, and u itself, linked to the smallest of u and its v."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (a, b); the label is the component's smallest node."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    pairs = ws.save(pairs, f"{name}-0")
    before, step = None, 0
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = ws.save(large, f"{name}-{step}-large")
        linked = _star(large)
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
        step += 1
        after = ws.save(small.filter("u > v").distinct(), f"{name}-{step}")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(f"{name}-{step - 1}-large", f"{name}-{step - 1}")
        pairs = after
        if mark == before:
            break
        before = mark
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
