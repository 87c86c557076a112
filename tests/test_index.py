"""The index end to end, against numpy."""

import numpy as np
import pytest

from mosaiq.plans.index import MultiVectorIndex, to_lists


def docs(n, tokens, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(t, dim)).astype(np.float32) for t in ([tokens] * n if isinstance(tokens, int) else tokens)]


def maxsim(q, d):
    return float((q @ d.T).max(1).sum())


def reconstructed(index, n):
    return [np.array(r["vectors"]) for r in index.get_embeddings(list(range(n))).orderBy("ord").collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    corpus = docs(30, [5, 20, 10, 3, 50] * 6)
    index = MultiVectorIndex(spark, path).create(corpus, kmeans_niters=2, n_centroids=16)
    return index, corpus


def test_exhaustive_search_is_maxsim_over_reconstructed_vectors(built):
    index, corpus = built
    queries = docs(3, 8, seed=1)
    found = to_lists(index.search(queries, top_k=10, n_full_scores=4 * len(corpus), n_ivf_probe=16), 3)
    rebuilt = reconstructed(index, len(corpus))
    for q, got in zip(queries, found):
        want = sorted(((maxsim(q, d), -k) for k, d in enumerate(rebuilt)), reverse=True)[:10]
        assert [d for d, _ in got] == [-k for _, k in want]
        assert np.allclose([s for _, s in got], [s for s, _ in want], atol=1e-3)
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)


def test_token_scores_sum_to_the_score(built):
    index, corpus = built
    queries = docs(2, 4, seed=2)
    rows = index.search_token_scores(queries, top_k=3).collect()
    assert len(rows) == 6
    for r in rows:
        matrix = np.array(r["token_scores"])
        assert matrix.shape == (4, len(corpus[r["doc_id"]]))
        assert abs(matrix.max(1).sum() - r["score"]) < 1e-3


def test_subsets(built):
    index, _ = built
    queries = docs(3, 4, seed=3)
    shared = to_lists(index.search(queries, top_k=5, subset=[0, 5, 10, 15, 20]), 3)
    assert all({d for d, _ in row} <= {0, 5, 10, 15, 20} and len(row) == 5 for row in shared)
    own = to_lists(index.search(queries, top_k=5, subset=[[0, 1], [2, 3], []]), 3)
    assert {d for d, _ in own[0]} <= {0, 1} and {d for d, _ in own[1]} <= {2, 3} and own[2] == []
    assert len(to_lists(index.search(queries, top_k=5, subset=[]), 3)[0]) == 5
    assert to_lists(index.search(queries, top_k=5, subset=[], strict_subset=True), 3) == [[], [], []]
    with pytest.raises(ValueError):
        index.search(queries, subset=[[1], [2]])


def test_query_shapes_and_limits(built):
    index, corpus = built
    ragged = docs(3, [2, 7, 4], seed=4)
    assert [len(x) for x in to_lists(index.search(ragged, top_k=100), 3)] == [30, 30, 30]
    padded = np.zeros((1, 9, 64), np.float32)
    padded[0, :2] = ragged[0]
    assert to_lists(index.search(padded, top_k=5), 1)[0] == to_lists(index.search(ragged, top_k=5), 3)[0]
    assert len(to_lists(index.search(ragged[:1], top_k=50, n_full_scores=20), 1)[0]) == 5
    assert len(to_lists(index.search(ragged[:1], top_k=5, n_ivf_probe=999), 1)[0]) == 5


def test_reconstruction_keeps_order_and_repeats(built):
    index, corpus = built
    rows = index.get_embeddings([7, 2, 7]).orderBy("ord").collect()
    assert [r["doc_id"] for r in rows] == [7, 2, 7]
    assert all(np.allclose(np.linalg.norm(r["vectors"], axis=1), 1, atol=1e-5) for r in rows)
    assert index.get_embeddings([]).count() == 0


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        MultiVectorIndex(spark, str(tmp_path / "none")).search(docs(1, 3))
    with pytest.raises(ValueError):
        MultiVectorIndex(spark, str(tmp_path / "a")).create(docs(3, 5), nbits=3)
    with pytest.raises(ValueError):
        MultiVectorIndex(spark, str(tmp_path / "b")).create(docs(3, 5, dim=12))
    with pytest.raises(ValueError):
        MultiVectorIndex(spark, str(tmp_path / "c")).create([np.zeros(3)])


def test_compress_only(spark, tmp_path):
    index = MultiVectorIndex(spark, str(tmp_path / "x")).create(docs(5, 4), kmeans_niters=1, compress_only=True, n_centroids=4)
    with pytest.raises(ValueError):
        index.search(docs(1, 3))
    index.update(docs(2, 4, seed=9), kmeans_niters=1)
    index.delete([0])
    assert index.state().manifest["compress_only"] and index.state().manifest["num_documents"] == 6
    assert not index.state().has("ivf") and len(reconstructed(index, 6)) == 6


def test_updates_and_deletions_match_a_list(spark, tmp_path):
    rng = np.random.default_rng(5)
    index = MultiVectorIndex(spark, str(tmp_path / "m"))
    model, meta, tag = [], [], 0
    for turn, (action, n) in enumerate([("add", 6), ("add", 3), ("del", 2), ("add", 5), ("del", 1), ("add", 2)]):
        if action == "add":
            new = docs(n, 3, seed=100 + turn)
            rows = [{"name": f"d{tag + k}", **({"late": k} if turn == 3 else {})} for k in range(n)]
            tag += n
            options = {"kmeans_niters": 1, "start_from_scratch": 4}
            if model:
                index.update(new, metadata_rows=rows, buffer_size=4, **options)
            else:
                index.create(new, metadata_rows=rows, n_centroids=4, **options)
            model += new
            meta += rows
        else:
            gone = [int(x) for x in rng.choice(len(model), n, replace=False)] + [999]
            index.delete(gone)
            model = [d for k, d in enumerate(model) if k not in gone]
            meta = [d for k, d in enumerate(meta) if k not in gone]
        assert index.state().manifest["num_documents"] == len(model)
        assert [r["name"] for r in index.get().collect()] == [m["name"] for m in meta]
        for d, r in zip(model, reconstructed(index, len(model))):
            unit = d / np.linalg.norm(d, axis=1, keepdims=True)
            assert r.shape == d.shape and (unit * r).sum(1).mean() > 0.3
        found = to_lists(index.search(docs(1, 3, seed=1), top_k=100, n_ivf_probe=99), 1)[0]
        assert sorted(x for x, _ in found) == list(range(len(model)))
    ids = [r["doc_id"] for r in index.where("late >= ?", [3]).collect()]
    assert sorted(ids) == [k for k, m in enumerate(meta) if m.get("late", -1) >= 3]


def test_buffered_tail_deletion(spark, tmp_path):
    """Deleting a waiting document, or the one before it, keeps the buffer right when it is flushed."""
    index = MultiVectorIndex(spark, str(tmp_path / "t")).create(docs(6, 3), kmeans_niters=1, n_centroids=4, start_from_scratch=2)
    tail = docs(3, 3, seed=50)
    index.update(tail, buffer_size=5, start_from_scratch=2)
    index.delete([8, 5])
    index.update(docs(4, 3, seed=60), buffer_size=5, kmeans_niters=1, start_from_scratch=2)
    kept = docs(6, 3)[:5] + tail[:2] + docs(4, 3, seed=60)
    assert index.state().manifest["num_documents"] == 11 and not index.state().has("buffer")
    for d, r in zip(kept, reconstructed(index, 11)):
        assert (d / np.linalg.norm(d, axis=1, keepdims=True) * r).sum(1).mean() > 0.3


def test_tiny_corpora(spark, tmp_path):
    for tokens in (1, 9, 10):
        index = MultiVectorIndex(spark, str(tmp_path / str(tokens))).create(docs(1, tokens), kmeans_niters=1)
        assert len(to_lists(index.search(docs(1, 2), top_k=5), 1)[0]) == 1


def test_stream_appends(spark, tmp_path):
    from mosaiq.streaming import appender

    rows = [(k, p, [float(x) for x in v]) for k, d in enumerate(docs(8, 3)) for p, v in enumerate(d)]
    spark.createDataFrame(rows, "doc_id long, pos int, v array<float>").coalesce(1).write.parquet(str(tmp_path / "in"))
    index = MultiVectorIndex(spark, str(tmp_path / "index")).create(docs(4, 3, seed=7), kmeans_niters=1)
    stream = spark.readStream.schema("doc_id long, pos int, v array<float>").parquet(str(tmp_path / "in"))
    appender.start(stream, index, str(tmp_path / "ck"), kmeans_niters=1).awaitTermination(120)
    assert index.state().manifest["num_documents"] == 12


def test_a_batch_is_appended_once(spark, tmp_path):
    """Also by another process: the number is in the manifest."""
    from mosaiq.sources.token_rows import from_arrays
    from mosaiq.streaming import appender

    path = str(tmp_path / "i")
    MultiVectorIndex(spark, path).create(docs(4, 3), kmeans_niters=1)
    batch = from_arrays(spark, docs(1, 3, seed=8))
    for number in (0, 0, 1):
        appender.append_batches(MultiVectorIndex(spark, path), kmeans_niters=1)(batch, number)
    appender.append_batches(MultiVectorIndex(spark, path), "another", kmeans_niters=1)(batch, 0)
    assert MultiVectorIndex(spark, path).state().manifest["num_documents"] == 7


def test_a_lock_outlives_its_writer_no_longer_than_it_must(spark, tmp_path, monkeypatch):
    from mosaiq.sources import snapshots

    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    store._write("LOCK", "dead")
    with pytest.raises(TimeoutError), store.lock(timeout=0.5):
        pass
    monkeypatch.setattr(snapshots, "STALE", 1.5)
    monkeypatch.setattr(snapshots, "RENEWED", 0.2)
    with store.lock(timeout=20):
        import time

        time.sleep(2.5)  # renewed meanwhile, so another writer doesn't take it
        with pytest.raises(TimeoutError), store.lock(timeout=0.3):
            pass
    assert store._read("LOCK") is None


def test_appends_are_merged(spark, tmp_path):
    from mosaiq.sources import snapshots

    index = MultiVectorIndex(spark, str(tmp_path / "c")).create(docs(5, 3), kmeans_niters=1, n_centroids=4, start_from_scratch=0, metadata_rows=[{"n": k} for k in range(5)])
    for k in range(snapshots.SEGMENTS + 2):
        index.update(docs(1, 3, seed=k + 1), start_from_scratch=0, buffer_size=99, metadata_rows=[{"n": 5 + k, "m": k}])
    tables = index.state().manifest["tables"]
    assert all(len(folders) <= snapshots.SEGMENTS for folders in tables.values())
    assert [r.n for r in index.get().collect()] == list(range(7 + snapshots.SEGMENTS))
    assert len(reconstructed(index, 7 + snapshots.SEGMENTS)) == 7 + snapshots.SEGMENTS and index.state().manifest["max_doclen"] == 3


def test_samples_are_about_as_large_as_wanted(spark):
    from mosaiq.operators import kmeans

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    some = kmeans.sample_documents(rows, 2_000, 20_000)
    assert abs(some.count() - 2_000) < 200 and some.collect() == kmeans.sample_documents(rows, 2_000, 20_000).collect()
    assert kmeans.sample_documents(rows, 20_000, 20_000).count() == 20_000


def test_a_ranking_is_cut_before_the_shuffle(spark):
    from mosaiq.operators import search

    rows = spark.range(10_000).selectExpr("id % 2 as query_id", "id as doc_id", "id * 1.0 as score")
    plan = search.rank(rows, 1024)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") >= 0 and plan.count("WindowGroupLimit") == 2
