"""Intermediate tables in the folder that all executors share.

Cutting lineage with a written table (and never with an executor-local copy) means that a lost
executor costs a re-read of Parquet files and nothing else.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by the session; only a local session without one gets a temporary folder."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="mosaiq-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


class Workspace:
    """Uniquely named Parquet tables under the shared folder; removed one by one or at exit."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self._remove, self.path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").mode("errorifexists").parquet(self.at(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.at(name))
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Remove all tables but these: what a result no longer reads."""
        self.drop(*(self.names - set(names)))

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; a leftover table is harmless
            pass


def dense_names(ws: Workspace, df: DataFrame, cols: list[str], table: str, out: str = "name") -> DataFrame:
    """Distinct rows of ``cols`` with their 0-based rank in sort order, without a one-task window.

    Rows are range-partitioned and sorted in place; a rank is the row's index in its partition plus
    the rows of all earlier partitions. Only one number per partition meets in one place.
    """
    ranked = (
        df.select(*cols)
        .distinct()
        .repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .select(*cols, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq"))
    )
    ranked = ws.save(ranked, table)
    index = F.col("_seq") % F.lit(1 << 33)
    sizes = {r["_part"]: r["n"] for r in ranked.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    offsets = ws.spark.createDataFrame(starts, "_part int, _start long")
    return ranked.join(F.broadcast(offsets), "_part").select(*cols, (F.col("_start") + index).alias(out))


def fits(df: DataFrame, limit: int) -> bool:
    """True if ``df`` has at most ``limit`` rows; reads no more than that many of them."""
    return df.limit(limit + 1).count() <= limit


def prefix_sums(ws: Workspace, df: DataFrame, key: str, value: str, table: str, out: str = "offset") -> DataFrame:
    """``df`` (unique ``key``) with the sum of ``value`` over all rows with smaller keys.

    As for dense names, partitions are ranges of the key: a running sum within each, plus the totals of
    all earlier partitions.
    """
    from pyspark.sql import Window

    ranged = df.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    ranged = ws.save(ranged, table)
    totals = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.sum(value).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(totals):
        starts.append((part, total))
        total += totals[part]
    before = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ws.spark.createDataFrame(starts, "_part int, _start long")
    summed = ranged.withColumn("_own", F.coalesce(F.sum(value).over(before), F.lit(0))).join(F.broadcast(offsets), "_part")
    return summed.select(*df.columns, (F.col("_start") + F.col("_own")).alias(out))
