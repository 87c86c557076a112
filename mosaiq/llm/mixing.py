"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

A source's share of the budget is proportional to its weight, but no more than ``max_epochs`` times
its own size. Sources above that are clamped and the excess is redistributed by weight; this repeats
until none is above. With the shares fixed, a document of a source is taken ``floor(target / size)``
times as a whole, and the fractional repetition is a seeded sample: the source's documents in order
of a hash of their ids, as long as more than half of the next one fits.

The sample needs no sort of a source in one place: sizes are summed by source and the first three
hex digits of the hash, the bucket in which the quota ends is found from these sums, and only that
bucket (about 1/4096 of a source) is ordered. What remains is one cut-off a source, with which every
document decides for itself.

Edge cases: a null text has size 0 and is taken 0 words; a null source is a source of its own and the
last in order; rows with the same id (or a null one) share one hash and are taken or left alike; a very long
text is one row that is taken whole or not; no row is taken more than ``max_epochs`` times; an empty table
gives an empty result. Extra columns stay as they are: rows are packed into one column while they are joined,
so that no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.plans.workspace import Workspace, dense_names, fits

from .common import WORD, packed, text_or_empty, unpacked

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Sources up to which their table (a few numbers each) is broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _draw(seed: int, id_col: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def targets(ws: Workspace, sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``; weights repeat over sources by code point, null last."""
    keyed = sources.withColumn("_null", F.col("source").isNull()).withColumn("_key", F.coalesce("source", F.lit("")))
    ranks = dense_names(ws, keyed, ["_null", "_key"], "ranks", "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    table = ws.save(
        keyed.join(ranks, ["_null", "_key"]).select(
            "source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("_cap")
        ),
        "sources",
    )
    budget = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, clamped = 0.0, -1
    while True:
        above = F.col("_cap") < F.col("weight") * F.lit(level)
        n, capped, free = table.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (budget - capped) / free
    share = F.least(F.col("_cap").cast("double"), F.col("weight") * F.lit(level))
    return table.select("source", "source_size", "weight", share.alias("target"))


def plan(sizes: DataFrame, ws: Workspace, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """From (doc_id, source, size): one row a source with target, whole repetitions and the sample's cut-off."""
    keyed = sizes.select("doc_id", "source", "size", _draw(seed).alias("_draw"))
    bucket = F.substring("_draw", 1, 3)
    sums = ws.save(
        keyed.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum")), "buckets"
    )
    shares = targets(ws, sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    shares = shares.withColumn("whole", whole.cast("long")).withColumn(
        "_quota", F.col("target") - F.col("whole") * F.col("source_size")
    )
    shares = ws.save(shares, "shares")
    small = fits(shares, BROADCAST_SOURCES)
    hint = F.broadcast if small else (lambda df: df)
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    s = shares.select(F.col("source").alias("_s"), "_quota")
    ends = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
        .join(hint(s), F.col("source").eqNullSafe(F.col("_s")))
        .filter("_before < _quota and _before + _sum > _quota or _before + _sum <= _quota")
        .groupBy("source")
        .agg(
            F.max(F.struct("_bucket", "_before", "_quota")).alias("_end"),
        )
        .select(F.col("source").alias("_s"), "_end._bucket", "_end._before", "_end._quota")
    )
    ends = ws.save(ends, "ends")
    inside = keyed.join(
        hint(ends), F.col("source").eqNullSafe(F.col("_s")) & (bucket == F.col("_bucket"))
    )
    order = Window.partitionBy("source", "_bucket").orderBy("_draw", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    cuts = (
        inside.withColumn("_upto", F.col("_before") + F.sum("size").over(order))
        .filter(F.col("_upto") - F.col("size") / 2 < F.col("_quota"))
        .groupBy("source")
        .agg(F.max("_draw").alias("_cut"))
    )
    edge = ends.select(F.col("_s").alias("_e"), F.col("_bucket").alias("_edge"))
    c = cuts.select(F.col("source").alias("_c"), "_cut")
    return (
        shares.join(edge, F.col("source").eqNullSafe(F.col("_e")), "left")
        .join(c, F.col("source").eqNullSafe(F.col("_c")), "left")
        .select("source", "source_size", "weight", "target", "whole", F.coalesce("_cut", "_edge").alias("cut"))
    )


def _with_plan(docs: DataFrame, shares: DataFrame, seed: int, id_col: str, source_col: str, max_epochs: int) -> DataFrame:
    """``row`` (the columns of ``docs``), ``m`` (its source's plan) and ``times``."""
    plans = shares.select(F.col("source").alias("of"), F.struct("source_size", "target", "whole", "cut").alias("m"))
    if fits(plans, BROADCAST_SOURCES):
        plans = F.broadcast(plans)
    rows = packed(docs, F.col(source_col).alias("from"), _draw(seed, id_col).alias("draw"))
    joined = rows.join(plans, F.col("from").eqNullSafe(F.col("of")))
    extra = F.when(F.col("draw") <= F.col("m.cut"), 1).otherwise(0)
    # Where a source is at its cap, rows of size 0 may draw an extra repetition; they have no more than the others.
    return joined.select("row", "m", F.least(F.col("m.whole") + extra, F.lit(max_epochs)).cast("int").alias("times"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, times, taken."""
    ws = Workspace(docs.sparkSession, "mix")
    sizes = ws.save(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")),
        "sizes",
    )
    shares = ws.save(plan(sizes, ws, weights, max_epochs, seed), "plan")
    return _with_plan(sizes, shares, seed, "doc_id", "source", max_epochs).select(
        "row.doc_id",
        "row.source",
        "row.size",
        "m.source_size",
        F.round("m.target", 6).alias("target"),
        "times",
        (F.col("times") * F.col("row.size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    ws = Workspace(docs.sparkSession, "mixed")
    sizes = ws.save(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")),
        "sizes",
    )
    shares = ws.save(plan(sizes, ws, weights, max_epochs, seed), "plan")
    taken = _with_plan(docs, shares, seed, id_col, source_col, max_epochs).filter("times > 0")
    return unpacked(taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))), docs.columns)
