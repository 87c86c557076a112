"""Toxicity by maximum-scoring segments.

Training reads a bounded sample of labelled rows (``max_rows``, in order of a hash of their ids).
Features of a token are itself (lower case, without punctuation at its ends) and its beginnings of 3
to 8 characters. A feature's score is its log-odds between toxic and clean documents under an
informative Dirichlet prior (the feature's share of all documents times ``prior_docs``); only features
that mark toxic documents beyond chance count. A token scores as its best feature, or a small negative
drift, the log-odds of a token without one.

Scoring is one linear pass over all tokens of a text that yields every maximal-scoring segment
(disjoint segments that no extension or union improves). A segment's score S in n tokens has the
extreme-value expectation ``E = n exp(-lambda S)`` where lambda solves ``sum p(s) exp(lambda s) = 1``
over clean tokens. Segments with ``E <= significance`` are reported as passages; the best segment's
``ln(1 + ln(1 + 1/E))`` and the number of passages are calibrated to a probability on the part of the
sample that chose no features.

Labels, language, source and ids are never inputs of a score. Edge cases: null and empty texts have
no segment and get the score of a text without one; labels that are null are ignored; repeated label
rows of one document count once (as toxic if any says so); very long texts are scored whole, in linear time;
of segments with the same score the first counts, and rows with the same text have the same score; without
any labelled row of either kind all scores are next to 1 or 0; an empty table gives an empty result. Only the
id and text columns (and the label's) are read, so extra columns never clash.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import limit_batches, slices, tidy
from .common import text_or_empty

#: The most labelled rows that training reads.
MAX_ROWS = 20_000
PREFIXES = (3, 4, 5, 6, 7, 8)
PRIOR_DOCS = 1.0
MIN_TOXIC_DOCS = 3
MIN_G = 20.0
#: Of a feature's documents, the toxic share if there were as many toxic as clean ones; so it doesn't depend on how rare they are.
MIN_PURITY = 0.75
SIGNIFICANCE = 0.01
THRESHOLD = 0.7
#: Bytes of text whose features are held at once, and words whose scores are remembered, in a task.
TRAINING_SLICE = 1 << 18
MEMO_WORDS = 200_000
_EDGE = ".,;:!?|%&#$*()[]{}\"'"


def features(word: str) -> set[str]:
    word = word.strip(_EDGE)
    found = {"^" + word[:n] for n in PREFIXES if len(word) >= n}
    if word:
        found.add(word)
    return found


@dataclass
class Model:
    """Scores of features, the drift, lambda and the calibration's coefficients."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = -0.01
    rate: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def token_scores(self):
        """A dictionary that computes and remembers the score of a word; 0 for none."""
        scores = self.scores

        class Memo(dict):
            def __missing__(memo, word):
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                found = max((scores[f] for f in features(word) if f in scores), default=0.0)
                memo[word] = found
                return found

        return Memo()

    def probability(self, best: np.ndarray, passages: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        return 1 / (1 + np.exp(-(a + b * _curve(best) + c * np.log1p(passages))))


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of a sequence whose tokens score
    ``drift`` but for ``hits`` (position, positive score), in time linear in the hits.

    A stack holds candidates with the sums before and after them. A new positive token is merged with
    the last candidate that starts lower, if everything since then stayed below the new sum.
    """
    stack: list[list[float]] = []  # first, last, sum before, sum after
    gained = 0.0
    for k, (at, score) in enumerate(hits):
        left = gained + drift * (at - k)
        gained += score
        new = [at, at, left, gained + drift * (at - k)]
        while True:
            j = len(stack) - 1
            skipped = []
            while j >= 0 and stack[j][2] >= new[2]:
                skipped.append(j)
                j = stack[j][4] if len(stack[j]) > 4 else j - 1
            if j < 0 or stack[j][3] >= new[3]:
                new = new[:4] + [j]
                stack.append(new)
                break
            new = [stack[j][0], at, stack[j][2], new[3]]
            del stack[j:]
    return [(int(s[0]), int(s[1]), s[3] - s[2]) for s in stack]


def _curve(best: np.ndarray) -> np.ndarray:
    """ln(1 + ln(1 + 1/E)) from ln 1/E: it rises with every bit of evidence, and slowly, so that no document outweighs all others."""
    return np.log1p(np.logaddexp(0.0, best))


def _hits(words: list[str], memo) -> list[tuple[int, float]]:
    return [(i, s) for i, s in enumerate(map(memo.__getitem__, words)) if s]


def _evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, int]:
    """ln 1/E of the best segment (that of a score of 0 without one) and the number of significant ones."""
    base = math.log(max(n, 1))
    logs = [model.rate * s - base for _, _, s in found]
    limit = -math.log(SIGNIFICANCE)
    return max(logs, default=-base), sum(x >= limit for x in logs)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    limit_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    spark = docs.sparkSession
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
        .withColumn("part", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)))
    )
    known = spark.createDataFrame(known.collect(), known.schema)
    rows = _rows(docs, id_col, text_col)
    sample = rows.join(F.broadcast(known), rows["doc_id"] == known["_id"]).select("text", "label", "part")

    def marks(keep):
        def work(batches):
            for batch in slices(batches, "text", TRAINING_SLICE):
                out, tox = [], []
                for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = set(text.decode("utf-8", "replace").lower().split())
                    found = set().union(*map(features, words)) if words else set()
                    found = [f for f in found if keep is None or f in keep]
                    out += found
                    tox += [label] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(tox, pa.int32())], ["f", "label"])

        return work

    choosing = sample.filter("part > 0").select("text", "label")
    n = {r["label"]: r["n"] for r in choosing.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(weights=(30.0 if n1 else -30.0, 0.0, 0.0))
    frequent = (
        choosing.filter("label = 1").mapInArrow(tidy(marks(None)), "f string, label int")
        .groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_TOXIC_DOCS)
    )
    keep = frozenset(r["f"] for r in frequent.collect())  # all that the sample has
    counts = (
        choosing.mapInArrow(tidy(marks(keep)), "f string, label int")
        .groupBy("f").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).collect()
    )
    model = Model()
    for f, a, b in counts:
        share = (a + b) / (n1 + n0)
        alpha = PRIOR_DOCS * share
        odds = math.log((a + alpha) / (n1 + PRIOR_DOCS - a - alpha + 1e-9)) - math.log((b + alpha) / (n0 + PRIOR_DOCS - b - alpha))
        expected = (a + b) * n1 / (n1 + n0)
        g = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0)) if a > expected else 0
        balanced = (a + 0.5) / n1 / ((a + 0.5) / n1 + (b + 0.5) / n0)
        if g >= MIN_G and balanced >= MIN_PURITY:
            model.scores[f] = round(min(odds, 8.0), 6)

    # Token frequencies: the drift from all tokens, lambda from those of clean documents.
    def tokens(batches):
        memo = model.token_scores()
        for batch in slices(batches):
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.decode("utf-8", "replace").lower().split()
                found = _hits(words, memo)
                out.append((label, len(words), [round(s, 1) for _, s in found]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.float64()))],
                ["label", "n", "s"],
            )

    seen = sample.select("text", "label").mapInArrow(tidy(tokens), "label int, n long, s array<double>")
    totals = {r["label"]: (r["n"], r["h"]) for r in seen.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.size("s")).alias("h")).collect()}
    (t1, h1), (t0, h0) = totals.get(1, (0, 0)), totals.get(0, (0, 0))
    q1, q0 = (h1 + 0.5) / (t1 + 1), (h0 + 0.5) / (t0 + 1)
    model.drift = min(math.log((1 - q1) / (1 - q0)), -1e-3)
    clean = {r["s"]: r["n"] for r in seen.filter("label = 0").select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    if not clean and model.scores:
        clean = {float(np.median(list(model.scores.values()))): 1}
    model.rate = _rate(clean, max(t0, 1), model.drift)

    calibrating = sample.filter("part = 0").select("text", "label")
    data = calibrating.mapInArrow(tidy(_scorer(model, labelled=True)), "label int, best double, passages int").collect()
    model.weights = _logistic(data) if data else (-2.0, 1.0, 0.0)
    return model


def _rate(counts: dict[float, int], total: int, drift: float) -> float:
    """The positive solution of sum p(s) exp(lambda s) = 1 by bisection."""
    if not counts:
        return 1.0
    hits = sum(counts.values())

    def excess(x):
        return sum(n / total * math.exp(min(x * s, 600)) for s, n in counts.items()) + max(1 - hits / total, 0) * math.exp(x * drift) - 1

    low, high = 0.0, 20.0
    if excess(1e-3) > 0:
        return 1e-3
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(data) -> tuple[float, float, float]:
    """Ridge logistic regression on (ln 1/E, ln(1 + passages)); slopes are kept non-negative."""
    y = np.array([r[0] for r in data], float)
    x = np.stack([np.ones(len(y)), _curve(np.array([r[1] for r in data], float)), np.log1p([r[2] for r in data])], 1)
    penalty = np.diag([1e-3, 0.05, 0.05])
    for use in ([0, 1, 2], [0, 1], [0, 2], [0]):
        w = np.zeros(len(use))
        xs, ps = x[:, use], penalty[np.ix_(use, use)]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
            step = np.linalg.solve(xs.T @ (xs * (p * (1 - p))[:, None]) + ps, xs.T @ (y - p) - ps @ w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-9:
                break
        full = np.zeros(3)
        full[use] = w
        if (full[1:] >= 0).all():
            break
    return tuple(float(round(v, 9)) for v in full)


def _scorer(model: Model, labelled: bool = False):
    def work(batches):
        memo = model.token_scores()
        for batch in slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            other = batch.column(1 if labelled else 0)
            best, passages, spans = [], [], []
            for data in texts:
                text = data.decode("utf-8", "replace")
                words = text.lower().split()
                found = segments(_hits(words, memo), model.drift)
                top, many = _evidence(model, len(words), found)
                best.append(top)
                passages.append(many)
                if not labelled:
                    spans.append(_passages(model, text, len(words), found) if many else [])
            if labelled:
                arrays = [other, pa.array(best, pa.float64()), pa.array(passages, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["label", "best", "passages"])
            else:
                scores = model.probability(np.array(best), np.array(passages))
                yield pa.RecordBatch.from_arrays([other, pa.array(scores, pa.float64()), pa.array(spans, pa.list_(PASSAGE))], ["doc_id", "score", "passages"])

    return work


PASSAGE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expect", pa.float64())])
_TOKEN = re.compile(r"\S+")


def _passages(model: Model, text: str, n: int, found) -> list[dict]:
    places = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out = []
    for first, last, score in found:
        log = model.rate * score - math.log(max(n, 1))
        if log >= -math.log(SIGNIFICANCE) and last < len(places):
            out.append({"start": places[first][0], "end": places[last][1], "score": score, "expect": math.exp(-min(log, 700))})
    return out


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, score (0 to 1), passages (array of start, end, score, expect)."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        tidy(_scorer(model)), f"doc_id {kind}, score double, passages array<struct<start:bigint,end:bigint,score:double,expect:double>>"
    )
