"""Queries of the catalogue do the whole job: against numpy and plain Python on small tables."""

import numpy as np
import pytest

from mosaiq.plans import catalog

LENGTHS = (1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """240 documents of 1 to 5 vectors; documents 40 and 0 are equal."""
    path = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(5)
    v = rng.normal(size=(720, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[120] = v[0]
    rows = [(k, x.tolist(), int(k % 3)) for k, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    docs, at = {}, 0
    for k in range(240):
        docs[k] = (v[at : at + LENGTHS[k % 5]].astype(float), at % 3)
        at += LENGTHS[k % 5]
    return str(path), docs


def best(docs, q, k):
    scores = {d: round(float((x @ docs[q][0].T).max(0).sum()), 6) for d, (x, _) in docs.items()}
    return sorted(scores, key=lambda d: (-scores[d], d))[:k]


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


ASKED = range(0, 240, 20)


def test_every_document_divisible_by_20_is_a_query(spark, tables):
    path, docs = tables
    assert found(catalog.search_topk_exact(spark, path).collect()) == {q: best(docs, q, 10) for q in ASKED}
    assert {r.query_id for r in catalog.query_explode(spark, path).collect()} == set(ASKED)
    assert {r.query_id for r in catalog.search_topk(spark, path).collect()} == set(ASKED)


def test_every_query_is_judged(spark, tables):
    path, docs = tables
    want = {q: sum(docs[d][1] == docs[q][1] for d in [d for d in best(docs, q, 11) if d != q][:5]) for q in ASKED}
    assert {r.query_id: r.value for r in catalog.eval_hits(spark, path).collect()} == want


def test_equal_queries_share_results_and_none_is_left_out(spark, tables):
    path, docs = tables
    assert found(catalog.eval_duplicates(spark, path).collect()) == {q: best(docs, q, 3) for q in ASKED}


def test_all_labels_are_appended_to_the_whole_metadata_table(spark, tmp_path):
    docs = [(3 * k, "en", f"src{k % 5}", k) for k in range(650)]
    labels = [(3 * k, k % 2, k % 3 % 2) for k in range(0, 650, 2)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = [(k, "en", f"src{k % 5}", k, None, None) for k in range(650)]
    want += [(650 + k, None, None, None, q, t) for k, (_, q, t) in enumerate(labels)]
    columns = ["_subset_", "lang", "source", "n_chars", "quality", "toxic"]
    assert sorted(map(tuple, catalog.meta_update(spark, str(tmp_path)).select(*columns).collect())) == want


def recall(found, want):
    return sum(len(set(found.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def test_searches_find_the_true_neighbours(spark, tables):
    path, docs = tables
    assert recall(found(catalog.search_topk(spark, path).collect()), {q: best(docs, q, 10) for q in ASKED}) >= 0.9
    within = lambda q, ids: [d for d in best(docs, q, len(docs)) if d in ids][:10]
    thirds, fourths = set(range(0, 240, 3)), set(range(0, 240, 4))
    assert found(catalog.search_shared_subset(spark, path).collect()) == {q: within(q, thirds) for q in ASKED}
    assert found(catalog.search_subset(spark, path).collect()) == {q: within(q, fourths) for q in ASKED}
    matrix = {}
    for r in catalog.token_scores(spark, path).collect():
        matrix.setdefault((r.query_id, r.doc_id), {})[r.qpos, r.pos] = r.sim
    assert matrix.keys() == {(q, d) for q in ASKED for d in best(docs, q, 10)}
    for (q, d), sims in matrix.items():
        want = docs[q][0] @ docs[d][0].T
        assert sims.keys() == set(np.ndindex(want.shape)) and all(abs(sims[k] - want[k]) < 1e-5 for k in sims)


def test_documents_that_cannot_reach_the_floor_are_skipped_without_loss(spark):
    from mosaiq.operators import codec, ivf, search
    from mosaiq.sources.token_rows import from_arrays

    rng = np.random.default_rng(2)
    centres = np.eye(8)
    arrays = [np.stack([centres[rng.integers(8)] + 0.02 * rng.normal(size=8) for _ in range(1 + k % 3)]).astype(np.float32) for k in range(120)]
    docs = from_arrays(spark, arrays)
    own = codec.Codec(2, centres, np.array([-0.01, 0.0, 0.01]), np.array([-0.02, -0.005, 0.005, 0.02]))
    rows = codec.encode(docs, own)
    queries = docs.filter("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    got = search.search_complete(queries, docs, rows, ivf.build(rows), own, search.Params(5, 8, 1)).collect()
    scores = {q: {d: round(float((x.astype(float) @ arrays[q].astype(float).T).max(0).sum()), 6) for d, x in enumerate(arrays)} for q in range(9)}
    assert found(got) == {q: sorted(s, key=lambda d: (-s[d], d))[:5] for q, s in scores.items()}
