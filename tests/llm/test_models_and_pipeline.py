"""Toxicity and language ID on held-out cases, and the pipeline against brute force."""

import collections
import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from mosaiq.llm import bpe, language, registry, toxicity

DATA = "/root/testdata/sf0.01"


# -- toxicity ---------------------------------------------------------------------------------------------


def brute_segments(scores):
    """All maximal-scoring segments by their recursive definition: the best, then those left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, _, a, b = best
    return brute_segments(scores[:a]) + [(a, b - 1, best[0])] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 3, 5, 8]), max_size=14), st.sampled_from([-1.0, -2.0, -0.5]))
def test_segments_are_maximal(hits, drift):
    scores = [h + 0.001 * k if h else drift for k, h in enumerate(hits)]  # no ties
    got = toxicity.segments([(k, s) for k, s in enumerate(scores) if s > 0], drift)
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(got, want))


def labelled(spark, n=900, seed=1):
    rng = random.Random(seed)
    bad, rows, labels = ["vilest", "scumbag", "trashlike"], [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(2, 6) * toxic):
            text.insert(rng.randrange(len(text) + 1), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.is_held_out().alias("h")).collect()}
    import zlib

    assert all(held[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in held)
    wrong = [i for i in rows if held[i] and (rows[i].score >= 0.7) != (i % 4 == 0)]
    assert len(wrong) <= 3 and all(0 <= r.score <= 1 for r in rows.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = next(r for i, r in rows.items() if r.passages)
    assert any(w in texts[toxic.doc_id][toxic.passages[0].start : toxic.passages[0].end] for w in ("vilest", "scumbag", "trashlike"))


def test_toxicity_ignores_ids_and_held_out_labels(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", labels["toxic"]).filter(~toxicity.is_held_out())
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_toxicity_without_labels_and_with_odd_rows(spark):
    docs, labels = labelled(spark, 60)
    assert {r.score < 0.01 for r in toxicity.score_documents(docs, toxicity.train(docs, labels.limit(0))).collect()} == {True}
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 100_000), (3, " \n\t")], "doc_id long, text string")
    assert toxicity.score_documents(odd, toxicity.train(docs, labels)).count() == 5
    assert toxicity.score_documents(odd.limit(0), toxicity.train(docs, labels)).count() == 0


# -- language ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(spark):
    return language.train(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_language_of_documents(spark, languages):
    rows = registry.op7_language(spark, DATA).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sum(truth[r.doc_id] == r.language for r in rows) >= 0.99 * len(rows) and all(r.kept for r in rows)


def test_trigrams_by_hand():
    import numpy as np
    import pyarrow as pa

    def brute(text):
        table = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text)
        padded = b" " + b" ".join(x for x in table.split(b" ") if x) + b" " if table.strip() else b" "
        codes = [(a << 16 | b << 8 | c) * 2654435761 % 2**32 >> 17 for a, b, c in zip(padded, padded[1:], padded[2:])]
        return codes

    texts = [b"", b"ab", "Été 1x".encode(), b"  a--b  ", b"...", b"xyz"]
    bucket, counts = language._trigrams(pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"]))
    parts = np.split(bucket, np.cumsum(counts)[:-1])
    assert [sorted(p.tolist()) for p in parts] == [sorted(brute(t)) for t in texts]


def test_evidence_is_fused(spark, languages):
    from pyspark.sql import functions as F

    rows = [(k, "und die der ist nicht", f"h{k % 2}", None) for k in range(60)] + [(100, "in", "h0", None), (101, "la", "h9", "fr-CA"), (102, None, "h0", None), (103, "...", "h0", "de")]
    pages = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string")
    got = {r.doc_id: r for r in language.identify(pages, languages, host=F.col("host"), declared=F.col("declared")).collect()}
    assert got[0].language == "de" and got[100].language == "de"  # the host prior decides a word of two languages
    assert got[101].language == "fr"  # the declaration does
    assert not got[102].kept and not got[103].kept
    host, domain, suffix = language.host_levels(F.col("u"))
    urls = spark.createDataFrame([("https://a.b.example.de:8080/x",), ("no address",)], "u string")
    assert [tuple(r) for r in urls.select(host, domain, suffix).collect()] == [("a.b.example.de", "example.de", "de"), (None, None, None)]


def test_rejected_rows_go_and_others_stay_whole(spark, languages):
    docs = spark.createDataFrame([(1, "the and of that", "s", 1), (1, "###", "s", 2), (None, "the with this", None, 3), (2, None, None, 4), (1, "the and of that", "s", 1)], "doc_id long, text string, source string, kept int")
    from pyspark.sql import functions as F

    left = language.keep_identified(docs, languages, host=F.col("source"))
    assert left.columns == docs.columns and sorted(r.kept for r in left.collect()) == [1, 1, 3]
    assert language.keep_identified(docs.limit(0), languages, host=F.col("source")).count() == 0


def test_posterior_by_hand(spark):
    """Likelihood, declaration, suffix and smoothed priors, with plain Python over a model of two languages."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    train = spark.createDataFrame([(1, "aba bab aab abba baba", "xx"), (2, "cdc dcd ccd cddc dcdc", "fil"), (3, "aba cdc", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    assert model.languages == ["fil", "xx"]
    rows = [(0, "aba bab", "h.a.co.uk", "XX-latn"), (1, "cdc", "g.a.co.uk", None), (2, "abcd", "h.a.co.uk", "fil-PH"), (3, "cd", "z.de", "fi"), (4, "?!", "z.de", "xx"), (5, None, None, None), (6, "aba", "z.de", None)]
    pages = spark.createDataFrame([(i, t, f"http://{h}/" if h else None, d) for i, t, h, d in rows], "doc_id long, text string, url string, declared string")
    host, domain, suffix = language.host_levels(F.col("url"))
    got = {r.doc_id: r for r in language.identify(pages, model, host=host, domain=domain, suffix=suffix, declared=F.col("declared")).collect()}

    def softmax(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    bucket, counts = language._trigrams(pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for _, t, _, _ in rows], pa.binary())], ["text"]))
    parts = np.split(bucket, np.cumsum(counts)[:-1])
    letters = [any(c.isalpha() for c in t or "") for _, t, _, _ in rows]
    mean = [model.log_prob[p].mean(0) if len(p) else np.zeros(2) for p in parts]
    alive = [a and m.max() + math.log(language.BUCKETS) > 0 for a, m in zip(letters, mean)]
    evidence = [m * min(len(p), language.MAX_EVIDENCE) if a else np.zeros(2) for m, p, a in zip(mean, parts, alive)]
    levels = [(h, h and ".".join(h.split(".")[-3 if h.endswith(".co.uk") else -2 :]), h and h.split(".")[-1]) for _, _, h, _ in rows]
    share = [softmax(e) if a else np.zeros(2) for e, a in zip(evidence, alive)]
    strength = language.PRIOR_STRENGTH
    root = sum(share) + 1
    root = root / root.sum()

    def smoothed(k, key, parent):
        own = sum(s for s, v in zip(share, levels) if v[k] == key)
        return (own + strength * parent) / (np.sum(own) + strength)

    for (i, _, h, said), e, a in zip(rows, evidence, alive):
        prior = np.log(root)
        if h:
            at = levels[i]
            live = any(b and v[0] == at[0] for b, v in zip(alive, levels))
            by_suffix = smoothed(2, at[2], root) if any(b and v[2] == at[2] for b, v in zip(alive, levels)) else root
            by_domain = smoothed(1, at[1], by_suffix)
            prior = np.log(smoothed(0, at[0], by_domain)) if live else np.log(root) + np.log(by_suffix / root)
        code = (said or "").lower().split("-")[0]
        told = [math.log(language.DECLARED_TRUST if x == code else 1 - language.DECLARED_TRUST) for x in model.languages] if code in model.languages else [0, 0]
        p = softmax(e + prior + told)
        assert abs(got[i].posterior - p.max()) < 1e-5 and got[i].language == model.languages[int(p.argmax())], i
        assert got[i].kept == (a and p.max() >= language.MIN_POSTERIOR)


def test_languages_unknown_to_the_model_are_rejected(spark, languages):
    texts = ["Это предложение написано по русски и никому не понятно", "xqzjv wkpft qqzx bvnm zxkj plmqw", "这是一个中文句子", "the and of that this with"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in language.keep_identified(docs, languages).collect()] == [3]


def test_languages_of_pages(spark):
    rows = {r.page_id: r for r in registry.language_of_pages(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert set(rows) == {r.page_id for r in pages} and all(r.language in ("de", "en", "es", "fr") and 0 < r.posterior <= 1 for r in rows.values())


def test_scores_by_hand():
    """Extreme-value evidence and calibrated score of a made-up model."""
    import numpy as np
    import pyarrow as pa

    model = toxicity.Model({"vile": 3.0, "^scu": 2.0, "scum": 4.0}, drift=-0.5, rate=0.8, weights=(-2.0, 1.5, 0.7))
    texts = ["", "good words only", "Vile, scum!", "scuba", "vile a a a a a a a a scum scum scum scum scum", "scum " * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts], pa.binary())], ["doc_id", "text"])
    out = next(iter(toxicity._scorer(model)([batch])))
    value = lambda w: max([model.scores[f] for f in toxicity.features(w) if f in model.scores], default=-0.5)
    for text, score, passages in zip(texts, out.column(1).to_pylist(), out.column(2).to_pylist()):
        words = text.lower().split()
        found = brute_segments([value(w) for w in words]) if len(words) < 100 else [(0, len(words) - 1, 4.0 * len(words))]
        logs = [0.8 * s - math.log(len(words)) for _, _, s in found]
        best, many = max(logs, default=-math.log(max(len(words), 1))), sum(x >= -math.log(toxicity.SIGNIFICANCE) for x in logs)
        want = 1 / (1 + math.exp(-(-2.0 + 1.5 * math.log1p(float(np.logaddexp(0, best))) + 0.7 * math.log1p(many))))
        assert math.isclose(score, want, rel_tol=1e-9) and len(passages) == many
    for counts, total, drift in (({2.0: 5, 4.0: 1}, 1000, -0.1), ({1.0: 50}, 100, -2.0)):
        x = toxicity._rate(counts, total, drift)
        left = total - sum(counts.values())
        assert abs(sum(n * math.exp(x * s) for s, n in counts.items()) + left * math.exp(x * drift) - total) < 1e-6 * total


# -- pipeline ---------------------------------------------------------------------------------------------


def test_stages_keep_columns_and_take_effect(spark):
    from pyspark.sql import functions as F

    from tests.llm.test_dedup_ops import components, norm

    from tests.llm.test_dedup_ops import CLASHING

    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 300")
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.lit(k))
    rows = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows.collect()
        rows = stage(spark, rows, DATA).persist()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == docs.columns, name
        after = rows.collect()
        if k == 0:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}  # nothing here is without a language
        if k == 1:
            first = {}
            for r in sorted(before):
                first.setdefault(norm(r.text), r)
            assert sorted(after) == sorted(first.values())
        if k == 2:
            ids = sorted(r.doc_id for r in before)
            texts = {r.doc_id: r.text for r in before}
            group = components([texts[i] for i in ids])
            assert sorted(r.doc_id for r in after) == [i for n, i in enumerate(ids) if group[n][1] == n]
        if k == 3:
            times = collections.Counter(r.doc_id for r in after)
            assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in before}
        if k == 4:
            own = bpe.codec(*bpe.default_ranks())
            texts = {r.doc_id: r.text for r in before}
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
            for r in after:
                ids = own.encoding.encode_ordinary(texts[r.doc_id])
                assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
