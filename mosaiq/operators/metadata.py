"""A schema-evolving metadata table and SQL conditions on it.

Rows are keyed by ``_subset_``, the document's number. Conditions are SQL text with ``?`` parameters in
the dialect of a common embedded database, translated where Spark differs: ``LIKE`` ignores case,
double-quoted names are identifiers, dividing whole numbers gives a whole number (``5 / 2`` is 2), and
division by zero gives NULL.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.plans.workspace import Workspace

from .mutate import apply_numbers, renumber

KEY = "_subset_"
_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
_PART = re.compile(r"('(?:[^']|'')*')|(\"(?:[^\"]|\"\")*\")|(\blike\b)", re.IGNORECASE)


def check_names(names: Iterable[str]) -> None:
    for name in names:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a column name: {name!r}")


def _kind(values: Iterable) -> T.DataType:
    """The type of the first value that isn't null; text if there is none."""
    first = next((v for v in values if v is not None), None)
    if isinstance(first, int):
        return T.LongType()
    if isinstance(first, float):
        return T.DoubleType()
    if first is None or isinstance(first, (str, datetime.date)):
        return T.StringType()
    return T.BinaryType()


def _cell(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(value, datetime.date) and isinstance(kind, T.StringType):
        return value.isoformat()
    return {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BinaryType: bytes}[type(kind)](value)


def rows_from(spark: SparkSession, rows: Sequence[Mapping], start: int = 0) -> DataFrame:
    """Python rows as a table numbered from ``start``; columns in the order in which they first occur."""
    names = list(dict.fromkeys(name for row in rows for name in row))
    check_names(names)
    kinds = {n: _kind(r.get(n) for r in rows) for n in names}
    schema = T.StructType([T.StructField(KEY, T.LongType()), *[T.StructField(n, kinds[n]) for n in names]])
    data = [(start + k, *[_cell(r.get(n), kinds[n]) for n in names]) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def create(metadata: DataFrame | Sequence[Mapping], spark: SparkSession | None = None) -> DataFrame:
    """A new table from Python rows or from a DataFrame that has ``_subset_``."""
    if isinstance(metadata, DataFrame):
        check_names(metadata.columns)
        return metadata
    return rows_from(spark, metadata)


def update(table: DataFrame, metadata: DataFrame | Sequence[Mapping]) -> DataFrame:
    """Rows appended after the highest number; new columns are added, missing values are NULL."""
    start = table.agg(F.coalesce(F.max(KEY) + 1, F.lit(0))).first()[0]
    if isinstance(metadata, DataFrame):
        check_names(metadata.columns)
        more = metadata.withColumn(KEY, F.col(KEY) + start) if KEY in metadata.columns else metadata
    else:
        more = rows_from(table.sparkSession, metadata, start)
    for field in more.schema:
        if field.name in table.columns and field.dataType != table.schema[field.name].dataType:
            more = more.withColumn(field.name, F.col(field.name).cast(table.schema[field.name].dataType))
    return table.unionByName(more, allowMissingColumns=True)


def delete(table: DataFrame, deleted: DataFrame | Sequence[int], ws: Workspace | None = None) -> DataFrame:
    """Without the rows of these numbers (in any order; unknown ones are ignored), renumbered from 0."""
    spark = table.sparkSession
    if not isinstance(deleted, DataFrame):
        ids = [deleted] if isinstance(deleted, int) else sorted(set(deleted))
        deleted = spark.createDataFrame([(int(i),) for i in ids], "doc_id long")
    ws = ws or Workspace(spark, "metadata")
    numbers = renumber(ws, table.select(F.col(KEY).alias("doc_id")), deleted, f"meta-{uuid.uuid4().hex}")
    return apply_numbers(table, numbers, KEY)


_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|[0-9.]+(?:[eE][+-]?[0-9]+)?|\w+|\s+|<=>|<=|>=|<>|!=|==|\|\||.", re.DOTALL)
#: Words after which an operand begins, so that they aren't the name of a function or a part of an operand.
_WORDS = frozenset("AND OR NOT IN IS BETWEEN LIKE ILIKE RLIKE ESCAPE CASE WHEN THEN ELSE SELECT WHERE DISTINCT EXISTS".split())
_WHOLE = "('tinyint', 'smallint', 'int', 'bigint')"


def _divided(a: str, b: str) -> str:
    """``a / b``: operands are written once, since they may hold parameters."""
    whole = f"typeof(d.a) IN {_WHOLE} AND typeof(d.b) IN {_WHOLE}"
    return f" transform(array(named_struct('a', {a.strip()}, 'b', {b.strip()})), d -> CASE WHEN {whole} THEN CAST(try_divide(d.a, d.b) AS BIGINT) ELSE try_divide(d.a, d.b) END)[0] "


def _divisions(tokens: list[str], at: int, closing: bool) -> tuple[str, int]:
    """The text from a token on (to its closing bracket) with each ``x / y`` rewritten; ``x`` is the product so far."""
    done, product, operator, operand, after = "", "", "", "", False

    def finish() -> str:
        if not operator:
            return operand
        if operator == "/":
            return _divided(product, operand)
        return product + operator + operand

    while at < len(tokens):
        token = tokens[at]
        at += 1
        if token == ")" and closing:
            break
        if token == "(":
            inner, at = _divisions(tokens, at, True)
            operand += f"({inner})"
            after = True
        elif token.isspace():
            operand += token
        elif token in "*/%" and after:
            product, operator, operand, after = finish(), token, "", False
        elif token.upper() in _WORDS or not (token[0].isalnum() or token[0] in "_'\"`?.") and not (token in "+-" and not after):
            done += finish() + token
            product, operator, operand, after = "", "", "", False
        else:
            operand += token
            after = token not in "+-"
    return done + finish(), at


def translate(condition: str) -> str:
    """A condition in Spark's dialect; text in single quotes is left alone."""

    def part(match: re.Match) -> str:
        if match[1]:
            return match[1].replace("\\", "\\\\")
        if match[2]:
            return "`" + match[2][1:-1].replace('""', '"').replace("`", "``") + "`"
        return "ILIKE"

    return _divisions(_TOKEN.findall(_PART.sub(part, condition)), 0, False)[0]


def select(table: DataFrame, condition: str | None = None, parameters: Sequence = ()) -> DataFrame:
    """Rows that meet the condition."""
    if condition is None:
        return table
    spark, view = table.sparkSession, f"metadata_{uuid.uuid4().hex}"
    values = [v.isoformat() if isinstance(v, datetime.date) else v for v in parameters]
    table.createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT * FROM {view} WHERE {translate(condition)}", args=values)
    finally:
        spark.catalog.dropTempView(view)


def where(table: DataFrame, condition: str, parameters: Sequence = ()) -> DataFrame:
    """(doc_id) of the rows that meet the condition: a subset for a search, never collected."""
    return select(table, condition, parameters).select(F.col(KEY).alias("doc_id"))


def get(table: DataFrame, condition: str | None = None, parameters: Sequence = (), subset: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Rows by condition (in order of number) or by number (in the order given, repeats kept, unknown ones skipped)."""
    if condition is not None and subset is not None:
        raise ValueError("give a condition or a subset, not both")
    if subset is None:
        return select(table, condition, parameters).orderBy(KEY)
    if not isinstance(subset, DataFrame):
        subset = [subset] if isinstance(subset, int) else subset
        subset = table.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(subset)], "ord long, doc_id long")
    wanted = subset.select("ord", F.col("doc_id").alias(KEY))
    return wanted.join(table, KEY).orderBy("ord").select("ord", *table.columns)
