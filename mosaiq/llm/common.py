"""Column helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from mosaiq.plans.workspace import Workspace

WHITESPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a two-column key table may be broadcast (about 24 MB as hashed rows).
BROADCAST_ROWS = 400_000
#: Binary logarithm of the bits that tell which keys may occur (at most 524,288 words, about 24 MB as hashed rows).
HINT_BITS = 25
#: Bytes up to which a table of lists may be broadcast.
BROADCAST_BYTES = 32 << 20


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even if the body uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Rows of a group from which on it is joined by broadcast and not by its key.
LARGE_GROUP = 1_000


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """``row``, all columns of ``docs`` in one, and further columns: no name can clash in a join with these."""
    return docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row"), *more)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that were packed."""
    return rows.select(*[F.col(f"row.{_quoted(c)}").alias(c) for c in columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the columns of their group (``size``: its rows). Rows of large groups stay where they are.

    Large are groups of ``LARGE_GROUP`` rows, and of more than one in ``limit`` of all rows where that is
    more. So fewer than ``limit`` groups are sent to all tasks, and none that is joined by key is hot.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(LARGE_GROUP, total // limit + 1)
    large = groups.filter(F.col(size) >= least)
    others = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(groups.filter(F.col(size) < least), keys)
    return rows.join(F.broadcast(large), keys).unionByName(others)


def parted_by_keys(rows: DataFrame, on: list[str], table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that surely have no partner in ``table`` by ``on`` = ``keys`` (of the same types), and the others.

    A table of ``HINT_BITS`` bits, one for each hash of a key, is sent to all tasks. Its size is fixed; where
    there are too many keys for it, more rows are among the others. Nulls are keys like any.
    """

    def slot(columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*[F.col(_quoted(c)) for c in columns]), F.lit(1 << HINT_BITS))

    bits = table.select(slot(keys).alias("slot")).select(F.shiftright("slot", 6).alias("_word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    words = bits.groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    told = packed(rows, slot(on).alias("slot")).join(F.broadcast(words), F.shiftright("slot", 6) == F.col("_word"), "left")
    known = F.coalesce(F.expr("(shiftrightunsigned(_bits, cast(slot & 63 as int)) & 1L) = 1L"), F.lit(False))
    return unpacked(told.filter(~known), rows.columns), unpacked(told.filter(known), rows.columns)


def numbered(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, text): every row with its text as bytes and a number of its own, in the order of ids.

    Whole numbers that are unique and not null are the numbers themselves. Otherwise rows are ordered by
    id (null last) and text and numbered: by ranges, one total a range, so that no task sees all rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    whole = isinstance(rows.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType))
    if whole and rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return rows.select("doc_id", F.col("doc_id").cast("long").alias("doc"), "text")
    order = ["_null", "doc_id", "_mark", "_salt"]
    keyed = rows.select("*", F.col("doc_id").isNull().alias("_null"), F.xxhash64("text").alias("_mark"), F.monotonically_increasing_id().alias("_salt"))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ws.save(ranged.select("doc_id", "text", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")), "numbered")
    starts, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())):
        starts.append((part, total))
        total += n
    starts = ws.spark.createDataFrame(starts, "_part int, _start long")
    return ranged.join(F.broadcast(starts), "_part").select("doc_id", (F.col("_start") + F.col("_seq") % F.lit(1 << 33)).alias("doc"), "text")
