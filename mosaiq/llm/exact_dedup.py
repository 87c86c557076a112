"""Exact document deduplication by deterministic block naming, with DataFrame operations only.

Every text is normalised (each run of white space becomes one space) and cut into blocks of
``block_bytes`` bytes. Distinct blocks are sorted and named by their rank, an integer. Then adjacent
names are paired, distinct pairs are sorted and named in turn, and so on until a document has one
name. Naming is injective on each level, so two documents have the same (level, name) exactly if
their normalised texts are equal.

Sorting and joining blocks by their bytes would move the corpus several times. Blocks are therefore
ordered by a 128-bit fingerprint, and one aggregation over (fingerprint, bytes) of all blocks proves
that no two different blocks share one; if any do, the next seed is tried. Names thus rest on
compared bytes and not on luck.

Edge cases: a null text is the empty text, which is one empty block. Of equal texts the row with the
smallest id stays, ids that are null come last, and of rows with the same id an arbitrary one stays.
Very long texts are many blocks, cut in segments. An empty table gives an empty result. Only the id and text
columns are read, and rows that stay are packed into one column while they are joined, so extra columns of
any name never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.workspace import Workspace, dense_names, fits

from .common import BROADCAST_ROWS, WHITESPACE, bind, join_groups, packed, parted_by_keys, text_or_empty, unpacked

BLOCK_BYTES = 4096
#: Texts are first cut into segments of this many blocks, so that very long ones aren't copied once a block.
SEGMENT_BLOCKS = 256


def _pieces(data: Column, width: int, body) -> Column:
    """``body`` of each ``width`` bytes of ``data``; of the empty string for empty data."""
    last = F.greatest(F.ceil(F.length(data) / F.lit(width)) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: bind(F.substring(data, i * width + 1, F.lit(width)), body))


def blocks(data: Column, width: int, body) -> Column:
    """``body`` of each block of ``width`` bytes, in order."""
    return F.flatten(_pieces(data, width * SEGMENT_BLOCKS, lambda segment: _pieces(segment, width, body)))


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WHITESPACE, " ")


def _fingerprint(seed: int):
    return lambda block: F.struct(
        F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(block, F.lit(2 * seed + 1)).alias("h2")
    )


def _injective(docs: DataFrame, text: str, width: int, seed: int) -> bool:
    """Whether no two different blocks have the same fingerprint: all bytes of all blocks are compared."""
    mark = _fingerprint(seed)
    content = docs.select(
        F.explode(
            bind(
                normalised(text).cast("binary"),
                lambda t: blocks(t, width, lambda b: F.struct(mark(b).alias("h"), b.alias("b"))),
            )
        ).alias("x")
    ).select("x.h.h1", "x.h.h2", "x.b")
    clashes = content.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    return clashes.isEmpty()


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, text_sha256, level, name, row (an id of the row) and the workspace's tables."""
    ws = Workspace(docs.sparkSession, "exact")
    seed = 0
    while not _injective(docs, text_col, block_bytes, seed):
        seed += 1
    mark = _fingerprint(seed)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        bind(
            normalised(text_col).cast("binary"),
            lambda t: F.struct(F.sha2(t, 256).alias("sha"), blocks(t, block_bytes, mark).alias("marks")),
        ).alias("x"),
    ).select("doc_id", "row", F.col("x.sha").alias("text_sha256"), F.col("x.marks").alias("marks"))
    rows = ws.save(rows, "rows")

    cells = rows.select("row", F.size("marks").alias("n"), F.posexplode("marks").alias("pos", "m")).select(
        "row", "n", "pos", "m.h1", "m.h2"
    )
    names = dense_names(ws, cells, ["h1", "h2"], "names0")
    level = 0
    cells = ws.save(cells.join(names, ["h1", "h2"]).select("row", "n", "pos", "name"), "cells0")
    ws.drop("names0")
    done = [cells.filter("n = 1").select("row", F.lit(0).alias("level"), "name")]
    while not cells.filter("n > 1").isEmpty():
        side = F.col("pos") % 2
        pairs = (
            cells.filter("n > 1")
            .groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.first("n").alias("n"),
                F.max(F.when(side == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        level += 1
        pairs = ws.save(pairs, f"pairs{level}")
        names = dense_names(ws, pairs, ["a", "b"], f"names{level}")
        cells = pairs.join(names, ["a", "b"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name")
        cells = ws.save(cells, f"cells{level}")
        ws.drop(f"pairs{level}", f"names{level}")
        done.append(cells.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return rows.drop("marks").join(identity, "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    ws = Workspace(docs.sparkSession, "exact-groups")
    ids = ws.save(identify(docs, id_col, text_col, block_bytes), "ids")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = ids.groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    return join_groups(ids, ws.save(groups, "groups"), ["level", "name"], "group_size").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def drop_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the (non-null) ids in ``dropped``: a broadcast if that has at most ``limit`` rows.

    Beyond, a bit table of fixed size tells which rows may go, and only these are joined with the ids.
    """
    gone = dropped.select(F.col(dropped.columns[0]).alias("gone"))
    rows = packed(docs, F.col(id_col).alias("id"))
    if fits(gone, limit):
        return unpacked(rows.join(F.broadcast(gone), F.col("id") == F.col("gone"), "left_anti"), docs.columns)
    stay, others = parted_by_keys(rows, ["id"], gone, ["gone"])
    return unpacked(stay.unionByName(others.join(gone, F.col("id") == F.col("gone"), "left_anti")), docs.columns)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Where an id is shared by several rows or null, rows are told apart by id and normalised text.
    """
    ws = Workspace(docs.sparkSession, "exact-keep")
    found = ws.save(exact_duplicates(docs, id_col, text_col, block_bytes), "found")
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return drop_ids(docs, found.filter("not kept").select("doc_id"), id_col)
    keys = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    rows = packed(docs, F.col(id_col).alias("id"), F.sha2(normalised(text_col).cast("binary"), 256).alias("sha"))
    stay = rows.join(keys, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return unpacked(stay.dropDuplicates(["id", "sha"]), docs.columns)
