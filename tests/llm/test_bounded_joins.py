"""Joins that send tables of bounded size to all tasks, against the plain join."""

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import common, exact_dedup, language, media, minhash


def test_groups_beyond_any_limit(spark):
    sizes = {"hot": 2_600, "warm": 1_200, "mild": 1_050, "cold": 3, "once": 1}
    rows = spark.createDataFrame([(k, n) for k, size in sizes.items() for n in range(size)], "k string, n long")
    groups = spark.createDataFrame([(k, size, k.upper()) for k, size in sizes.items()], "k string, size long, told string")
    wanted = sorted(map(tuple, rows.join(groups, "k").select("k", "n", "told").collect()))
    for limit in (1, 2, 400_000):
        got = common.join_groups(rows, groups, ["k"], "size", limit)
        assert sorted(map(tuple, got.select("k", "n", "told").collect())) == wanted
    assert common.join_groups(rows.limit(0), groups.limit(0), ["k"], "size").count() == 0


@pytest.mark.parametrize("bits", [6, 8, 25])
def test_no_partner_is_missed(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "HINT_BITS", bits)
    rows = spark.range(500).select(F.when(F.col("id") > 0, F.col("id")).alias("slot"), F.col("id").alias("_bits"))
    keys = rows.filter("slot is null or slot % 50 = 0").select(F.col("slot").alias("gone"))
    alone, others = common.parted_by_keys(rows, ["slot"], keys, ["gone"])
    alone, others = {tuple(r) for r in alone.collect()}, {tuple(r) for r in others.collect()}
    assert len(alone) + len(others) == 500 and not alone & others
    assert {(None, 0), *((k, k) for k in range(50, 500, 50))} <= others
    assert bits < 25 or len(others) == 10
    assert common.parted_by_keys(rows, ["slot"], keys.limit(0), ["gone"])[0].count() == 500


def test_ids_are_dropped_at_any_number(spark):
    docs = spark.createDataFrame([(k if k else None, "x", "y") for k in range(300)], "doc_id long, gone string, `_bits` string")
    dropped = docs.filter("doc_id % 3 = 0").select("doc_id")
    wanted = sorted(map(str, exact_dedup.drop_ids(docs, dropped).collect()))
    got = exact_dedup.drop_ids(docs, dropped, limit=0)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == wanted and len(wanted) == 201


def test_operators_beyond_the_broadcast_limits(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    strange = spark.createDataFrame([(None, "12 34", "z"), (-1, None, "z"), (-1, None, "z")], "doc_id long, text string, source string")
    docs = docs.unionByName(strange, allowMissingColumns=True)
    near = docs.filter("doc_id >= 0")

    def run():
        model = language.train(docs)
        return [
            sorted(map(str, df.collect()))
            for df in (
                media.media_features(docs),
                minhash.near_duplicates(docs),
                minhash.drop_near_duplicates(near),
                language.keep_identified(docs, model, host=F.col("source")),
            )
        ]

    wanted = run()
    monkeypatch.setattr(media, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(media, "BROADCAST_MEDIA", 1)
    for module in (minhash, language):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert run() == wanted
