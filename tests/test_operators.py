"""Operators one by one: traps of the codec, k-means, metadata dialect, evaluation, snapshots."""

import datetime
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.functions import dense, vectors
from mosaiq.operators import codec, evaluation, ivf, kmeans, metadata, mutate, search
from mosaiq.plans.workspace import Workspace, dense_names, prefix_sums
from mosaiq.sources import beir, token_rows
from mosaiq.sources.snapshots import Snapshots


def token_frame(spark, arrays):
    rows = [(d, p, [float(x) for x in v]) for d, a in enumerate(arrays) for p, v in enumerate(a)]
    return spark.createDataFrame(rows, "doc_id long, pos int, v array<double>")


def arrays(n=12, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(1 + k % 4, dim)) for k in range(n)]


# -- codec -------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.sampled_from([1, 2, 4, 8]), st.integers(1, 4), st.integers(0, 5), st.integers(0, 2**31))
def test_packing_is_reversible(nbits, eighths, rows, seed):
    buckets = np.random.default_rng(seed).integers(0, 1 << nbits, (rows, 8 * eighths)).astype(np.uint8)
    packed = dense.pack(buckets, nbits)
    assert packed.shape == (rows, eighths * nbits) and (dense.unpack(packed, nbits, 8 * eighths) == buckets).all()


def test_a_value_on_a_cutoff_is_in_the_lower_bucket(spark):
    cuts = [-0.1, 0.1, 0.3]
    values = [-0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4]
    want = [0, 0, 1, 1, 2, 2, 3]
    assert dense.bucketize(np.array(values), np.array(cuts)).tolist() == want
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in rows.select(vectors.bucket(rows["x"], cuts)).collect()] == want


def test_quantiles_are_interpolated(spark):
    rows = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "r array<double>")
    cuts, weights = codec.quantiles(rows, 2)
    assert np.allclose(cuts, [1.5, 3.0, 4.5]) and np.allclose(weights, [0.75, 2.25, 3.75, 5.25])


def test_layout_is_checked():
    for nbits, dim in ((3, 8), (0, 8), (4, 12)):
        with pytest.raises(ValueError):
            codec.check_layout(nbits, dim)
    assert codec.held_out_size(1) == 1 and codec.held_out_size(9) == 1 and codec.held_out_size(500) == 25 and codec.held_out_size(10**9) == 50_000


def test_documents_without_tokens(spark):
    docs = spark.createDataFrame([(0, [[1.0] * 8]), (1, []), (2, [[0.0] * 8, [1.0] * 8])], "doc_id long, vectors array<array<float>>")
    own = codec.Codec(2, np.eye(8), np.array([-0.1, 0.0, 0.1]), np.array([-0.2, -0.05, 0.05, 0.2]))
    rows = {r.doc_id: r for r in codec.encode(docs, own).collect()}
    assert [len(rows[k].codes) for k in range(3)] == [1, 0, 2] and [len(rows[k].residuals) for k in range(3)] == [2, 0, 4]
    assert {r.doc_id: len(r.vectors) for r in codec.decode(codec.encode(docs, own), own).collect()} == {0: 1, 1: 0, 2: 2}
    assert ivf.stats(codec.encode(docs, own)).first().num_embeddings == 3


# -- k-means -----------------------------------------------------------------------------------------------


def test_ties_go_to_the_lowest_code(spark):
    rows = token_frame(spark, [np.ones((2, 4))])
    same = np.stack([np.zeros(4), np.ones(4), np.ones(4)])
    assert [r.code for r in kmeans.assign(rows, same).collect()] == [1, 1]
    assert [r.code for r in kmeans.assign(rows, same, "dot").collect()] == [1, 1]


def test_blocks_of_centroids_agree_with_one(spark, monkeypatch):
    rows, centroids = token_frame(spark, arrays()), np.random.default_rng(1).normal(size=(11, 8))
    for metric in ("distance", "dot"):
        whole = {(r.doc_id, r.pos): r.code for r in kmeans.assign(rows, centroids, metric).collect()}
        monkeypatch.setattr(kmeans, "BROADCAST_BYTES", 3 * 8 * 8)
        assert whole == {(r.doc_id, r.pos): r.code for r in kmeans.assign(rows, centroids, metric).collect()}
        monkeypatch.undo()
        table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centroids)], "code int, cv array<double>")
        assert whole == {(r.doc_id, r.pos): r.code for r in kmeans.assign_sql(rows, table, metric).collect()}


def test_empty_clusters_become_tokens(spark):
    rows = token_frame(spark, arrays())
    centroids = np.concatenate([kmeans.seeds(rows, 2), np.full((1, 8), 1e6)])
    moved = kmeans.step(rows, centroids)
    assert np.isfinite(moved).all() and any(np.allclose(moved[2], v) for a in arrays() for v in a)


def test_sizes():
    assert kmeans.sample_size(10) == 10 and kmeans.sample_size(10**6) == 1 + int(16 * math.sqrt(120 * 10**6))
    assert kmeans.partition_count(100, 300) == 2048 and kmeans.partition_count(1, 1) == 16
    assert kmeans.expanded_count(0) == 1 and kmeans.expanded_count(257) == 8


def test_too_few_tokens(spark):
    with pytest.raises(ValueError):
        kmeans.seeds(token_frame(spark, arrays(1)), 5)


def test_training_is_reproducible(spark):
    docs = token_rows.nested(token_frame(spark, arrays(30)))
    assert np.array_equal(kmeans.codebook(docs, 2, k=4, seed=7), kmeans.codebook(docs.repartition(5), 2, k=4, seed=7)) or np.allclose(
        kmeans.codebook(docs, 2, k=4, seed=7), kmeans.codebook(docs.repartition(5), 2, k=4, seed=7)
    )


# -- search ------------------------------------------------------------------------------------------------


def test_maxsim_takes_the_best_document_token_for_each_query_token(spark):
    docs = arrays()
    queries = {0: docs[0], 1: docs[5][:1]}
    nested = token_rows.nested(token_frame(spark, docs))
    got = {(r.query_id, r.doc_id): r.score for r in search.bruteforce(nested, queries).collect()}
    for q, x in queries.items():
        for d, y in enumerate(docs):
            assert abs(got[q, d] - (x @ y.T).max(1).sum()) < 1e-5
    asked = token_frame(spark, list(queries.values())).selectExpr("doc_id as query_id", "pos as qpos", "v as qv")
    other = {(r.query_id, r.doc_id): r.score for r in search.maxsim_sql(token_frame(spark, docs), asked).collect()}
    assert other.keys() == got.keys() and all(abs(other[k] - got[k]) < 2e-6 for k in got)


def test_equal_documents_rank_by_number(spark):
    docs = [np.ones((1, 8))] * 5
    found = search.bruteforce_topk(token_rows.nested(token_frame(spark, docs)), {0: np.ones((2, 8))}, 3)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [0, 1, 2]


def test_batches_of_queries():
    queries = {k: np.zeros((2, 8)) for k in range(5)}
    assert [list(b) for b in search.query_batches(queries, 2 * 2 * 8 * 8)] == [[0, 1], [2, 3], [4]]
    assert search.Params(n_full_scores=4096).reranked == 1024 and search.Params(n_full_scores=3).reranked == 1


# -- changes -----------------------------------------------------------------------------------------------


def test_dense_names_and_prefix_sums(spark):
    rng = random.Random(2)
    ids = [rng.randrange(10**6) for _ in range(500)] + [None]
    ws = Workspace(spark, "test")
    rows = spark.createDataFrame([(i,) for i in ids], "x long").repartition(7)
    names = {r.x: r.name for r in dense_names(ws, rows, ["x"], "names").collect()}
    order = [None] + sorted(set(ids) - {None})
    assert names == {x: k for k, x in enumerate(order)}
    values = spark.createDataFrame([(k, k % 5) for k in range(300)], "k long, v long").repartition(6)
    sums = {r.k: r.offset for r in prefix_sums(ws, values, "k", "v", "sums").collect()}
    assert all(sums[k] == sum(j % 5 for j in range(k)) for k in range(300))


def test_outliers_and_expansion(spark):
    near = np.eye(8)[:2]
    rows = token_frame(spark, [near, np.full((5, 8), 3.0) + np.arange(5)[:, None]])
    assert mutate.outliers(rows, near, 0.5).count() == 5
    grown = mutate.expand(rows, near, 0.5, 2, max_points=2)
    assert len(grown) == 2 + 5 and np.array_equal(grown[:2], near) and np.allclose(np.linalg.norm(grown[2:], axis=1), 1)
    assert mutate.expand(rows, near, 1e9).shape == near.shape
    assert mutate.merge_thresholds(1.0, 3, 2.0, 1) == 1.25


# -- metadata ----------------------------------------------------------------------------------------------

PEOPLE = [
    {"name": "Alice", "age": 30, "height": 1.7, "joined": datetime.date(2023, 1, 5)},
    {"name": "alan", "age": 25, "height": None, "joined": datetime.date(2023, 4, 1)},
    {"name": "Charlie", "age": 41, "town": "Lyon"},
]


def test_metadata_life(spark):
    table = metadata.create(PEOPLE, spark)
    kinds = dict(table.dtypes)
    assert kinds == {"_subset_": "bigint", "name": "string", "age": "bigint", "height": "double", "joined": "string", "town": "string"}
    where = lambda c, p=(): sorted(r.doc_id for r in metadata.where(table, c, p).collect())
    assert where("age > ?", [28]) == [0, 2] and where("joined > '2023-03-01'") == [1] and where("joined > ?", [datetime.date(2023, 3, 1)]) == [1]
    assert where("name LIKE 'A%'") == [0, 1] and where("\"name\" = ? AND name <> 'like'", ["Alice"]) == [0] and where("age = ?", [99]) == []
    more = metadata.update(table, [{"name": "Bob", "vip": True}, {}])
    assert [(r["_subset_"], r["name"], r["vip"]) for r in metadata.get(more).collect()][3:] == [(3, "Bob", 1), (4, None, None)]
    left = metadata.delete(more, [4, 1, 77])
    assert [(r["_subset_"], r["name"]) for r in metadata.get(left).collect()] == [(0, "Alice"), (1, "Charlie"), (2, "Bob")]
    assert [r["name"] for r in metadata.get(left, subset=[2, 0, 2, 55]).collect()] == ["Bob", "Alice", "Bob"]
    assert [r["name"] for r in metadata.get(left, "age >= ?", [35]).collect()] == ["Charlie"]
    with pytest.raises(ValueError):
        metadata.get(left, "age > 1", subset=[1])
    with pytest.raises(ValueError):
        metadata.create([{"bad name": 1}], spark)


def test_conditions_are_translated():
    assert metadata.translate("a LIKE 'x LIKE y' AND \"b\" like ?") == "a ILIKE 'x LIKE y' AND `b` ILIKE ?"
    assert metadata.translate("a = 'x / y' AND `p/q` = 1") == "a = 'x / y' AND `p/q` = 1"


@pytest.mark.parametrize(("condition", "parameters", "want"), [
    ("1 / a > 0", [], [1]), ("5 / 2 = 2", [], [0, 1, 2]), ("5 / 2.0 = 2.5", [], [0, 1, 2]), ("a*7 / b-1 = ?", [2], [1]), ("b / (a / a) IS NULL", [], [0]),
    ("CASE WHEN b/a>1 THEN 1 ELSE 0 END = 1", [], [1, 2]), ("a BETWEEN ? / 2 AND 4", [3], [1, 2]), ("-b/-a = 2", [], [1]), ("abs(a-b)/b*b + b/b = ?", [1], [1, 2]), ("b/2 IN (1, 8/2)", [], [0, 1]),
])
def test_division(spark, condition, parameters, want):
    table = metadata.create([{"a": 0, "b": 3}, {"a": 1, "b": 2}, {"a": 2, "b": 7}], spark)
    assert sorted(r.doc_id for r in metadata.where(table, condition, parameters).collect()) == want


# -- evaluation --------------------------------------------------------------------------------------------


def test_metrics_by_hand(spark):
    results = spark.createDataFrame([("q", d, k + 1) for k, d in enumerate("abcde")] + [("r", "x", 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 1), ("q", "d", 1), ("q", "z", 1), ("r", "y", 1), ("q", "a", 0)], "query_id string, doc_id string, rel int")
    got = evaluation.evaluate(results, qrels, ("ndcg@10", "hits@1", "hits@5", "recall@5", "map"))
    dcg = 1 / math.log2(3) + 1 / math.log2(5)
    ideal = sum(1 / math.log2(k + 1) for k in (1, 2, 3))
    want = {"ndcg@10": dcg / ideal / 2, "hits@1": 0.0, "hits@5": 1.0, "recall@5": 2 / 3 / 2, "map": (1 / 2 + 2 / 4) / 3 / 2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError):
        evaluation.evaluate(results, qrels, ("mrr@1",))


def test_duplicates_and_self_matches(spark):
    results = spark.createDataFrame([(0, 0, 1, 3.0), (0, 5, 2, 2.0)], "query_id long, doc_id long, rank int, score double")
    queries = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "query_id long, query string")
    assert sorted((r.query_id, r.doc_id) for r in evaluation.add_duplicates(results, queries).collect()) == [(0, 0), (0, 5), (2, 0), (2, 5)]
    assert [(r.doc_id, r.rank) for r in evaluation.drop_self_matches(results).collect()] == [(5, 1)]


# -- sources -----------------------------------------------------------------------------------------------


def test_retrieval_data_sets(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d2", "title": "T", "text": "two"}\n{"_id": "d1", "title": "", "text": "one"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "what"}\n{"_id": "q2", "text": "unjudged"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\n")
    documents, queries, qrels, ids = beir.load(spark, str(tmp_path))
    assert sorted(map(tuple, documents.collect())) == [("d1", "one"), ("d2", "T two")]
    assert [tuple(r) for r in queries.collect()] == [("q1", "what")] and [tuple(r) for r in qrels.collect()] == [("q1", "what", "d1", 1)]
    assert sorted(map(tuple, ids.collect())) == [(0, "d1"), (1, "d2")]


def test_snapshots_append_and_sweep(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.current() is None
    row = lambda k: spark.createDataFrame([(k,)], "x long")
    m = store.commit({"a": row(1)}, {}, {})
    for k in (2, 3, 4):
        m = store.commit({"a": row(k)}, m["tables"], {})
    assert store.current() == 4 and sorted(r.x for r in store.table(m, "a").collect()) == [1, 2, 3, 4]
    m = store.commit({"a": row(9)}, {}, {})
    m = store.commit({"a": row(10)}, m["tables"], {})
    assert [p.name for p in sorted((tmp_path / "s").glob("v*"))] == ["v5", "v6"]
    with store.lock(), pytest.raises(TimeoutError), store.lock(timeout=0.5):
        pass


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "rank", "doc_id", "score"] and e.entry(spark).count() > 0
    missing = set(e.oracle_sql()) - set(e.queries())
    assert not missing
