"""Search as one plan over all queries: probe, candidates, approximate scores, prune, re-rank, top k.

Relevance is MaxSim: the sum over query tokens of the greatest dot product with a document token. Each
stage is a function from DataFrames to a DataFrame. Centroids and queries are broadcast to the scoring
kernels; batches of queries beyond ``QUERY_BYTES`` are split by the caller (``query_batches``), so what
is broadcast never grows with the data. Document rows meet candidates in an equi-join on doc_id, which
adaptive execution can split where a cell is hot.

Scores are rounded to ``DIGITS`` places before they are ranked, and ties go to the lowest document, so
that a ranking doesn't depend on the order of additions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import dense, vectors

from .codec import Codec, codes_of, packed_of

DIGITS = 6
#: The setting that bounds the ``n`` for which Spark ranks before it shuffles.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Bytes of query vectors that one plan broadcasts.
QUERY_BYTES = 32 << 20
#: Pairs (query_id, doc_id) up to which they are broadcast to the document rows, so that these aren't shuffled.
BROADCAST_PAIRS = 2_000_000


@dataclass
class Params:
    top_k: int = 10
    n_full_scores: int = 4096
    n_ivf_probe: int = 8

    @property
    def reranked(self) -> int:
        """Documents a query that get an exact score."""
        return min(self.n_full_scores, max(1, self.n_full_scores // 4))


def collect_queries(queries: DataFrame) -> dict[int, np.ndarray]:
    """Queries as matrices on the driver; they are the caller's own input, not data of the index."""
    return {r["query_id"]: np.array(r["vectors"], np.float64).reshape(len(r["vectors"]), -1) for r in queries.collect()}


def query_batches(queries: dict[int, np.ndarray], limit: int = QUERY_BYTES) -> list[dict[int, np.ndarray]]:
    batches, size = [{}], 0
    for key, value in queries.items():
        if size and size + value.nbytes > limit:
            batches.append({})
            size = 0
        batches[-1][key] = value
        size += value.nbytes
    return batches


def rank(df: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The ``n`` best rows of each query, with ``rank`` from 1.

    Tasks rank their own rows first and send only the ``n`` best of a query on; Spark plans that up to a
    threshold of its own, which is raised where ``n`` is more.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT)) < n:
        conf.set(GROUP_LIMIT, str(n))
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def maxsim_pairs(pairs: DataFrame, queries: dict[int, np.ndarray], score: str = "score") -> DataFrame:
    """(query_id, doc_id, score) from (query_id, doc_id, vectors)."""
    shared = pairs.sparkSession.sparkContext.broadcast(queries)

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = np.asarray(part.column(0))
                x, ends = dense.ragged(part.column(2))
                out = np.zeros(len(ids))
                for q in np.unique(ids):
                    for row in np.flatnonzero(ids == q):
                        if ends[row + 1] > ends[row] and len(shared.value[q]):
                            out[row] = (x[ends[row] : ends[row + 1]] @ shared.value[q].T).max(0).sum()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.round(out, DIGITS))], ["query_id", "doc_id", score])

    return pairs.select("query_id", "doc_id", "vectors").mapInArrow(work, f"query_id long, doc_id long, {score} double")


def bruteforce(documents: DataFrame, queries: dict[int, np.ndarray], top_k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) for all queries and documents: each document row is scored against the broadcast queries.

    With ``top_k`` a task returns only its own best documents of each query, among which are the best of all.
    """
    shared = documents.sparkSession.sparkContext.broadcast(queries)

    def work(batches):
        order = sorted(q for q in shared.value if len(shared.value[q]))
        if not order:
            return
        stacked = np.concatenate([shared.value[q] for q in order])
        first = np.concatenate([[0], np.cumsum([len(shared.value[q]) for q in order])])[:-1]
        rows = lambda score, docs: pa.RecordBatch.from_arrays([pa.array(np.tile(order, len(score)), pa.int64()), pa.array(docs.ravel(), pa.int64()), pa.array(score.ravel())], ["query_id", "doc_id", "score"])
        top, at = np.zeros((0, len(order))), np.zeros((0, len(order)), np.int64)
        for batch in batches:
            step = max(1, dense.BLOCK // max(len(stacked) * 32, 1))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                x, ends = dense.ragged(part.column(1))
                filled = np.flatnonzero(np.diff(ends) > 0)
                if not len(filled):
                    continue
                best = np.maximum.reduceat(x @ stacked.T, ends[:-1][filled], axis=0)
                score = np.round(np.add.reduceat(best, first, axis=1), DIGITS)
                docs = np.repeat(np.asarray(part.column(0))[filled][:, None], len(order), axis=1)
                if top_k is None:
                    yield rows(score, docs)
                else:
                    top, at = np.concatenate([top, score]), np.concatenate([at, docs])
                    best = np.lexsort((at, -top), axis=0)[:top_k]
                    top, at = np.take_along_axis(top, best, 0), np.take_along_axis(at, best, 0)
        for k in range(0, len(top), 16):
            yield rows(top[k : k + 16], at[k : k + 16])

    return documents.select("doc_id", "vectors").mapInArrow(work, "query_id long, doc_id long, score double")


def bruteforce_topk(documents: DataFrame, queries: dict[int, np.ndarray], top_k: int) -> DataFrame:
    """Exact top k: every task keeps its own ``top_k`` documents a query, so few rows are shuffled."""
    return rank(bruteforce(documents, queries, top_k), top_k)


def maxsim_sql(tokens: DataFrame, query_tokens: DataFrame) -> DataFrame:
    """Exact MaxSim as joins and grouped aggregates, for small data and for comparison."""
    sims = tokens.join(F.broadcast(query_tokens)).withColumn("sim", vectors.dot(F.col("v"), F.col("qv")))
    best = sims.groupBy("query_id", "qpos", "doc_id").agg(F.max("sim").alias("m"))
    return best.groupBy("query_id", "doc_id").agg(F.round(F.sum("m"), DIGITS).alias("score"))


def centroid_scores(query_tokens: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(query_id, qpos, code, score): query tokens against all centroids."""
    shared = query_tokens.sparkSession.sparkContext.broadcast(centroids)

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                s = dense.vectors(part.column(2)) @ shared.value.T
                n, m = s.shape
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(np.repeat(np.arange(n), m))) for c in (0, 1)), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(s.ravel())], ["query_id", "qpos", "code", "score"])

    return query_tokens.select("query_id", "qpos", "qv").mapInArrow(work, "query_id long, qpos int, code int, score double")


def probe(queries: DataFrame, centroids: np.ndarray, n_probe: int, allowed: DataFrame | None = None) -> DataFrame:
    """Distinct (query_id, code): the ``n_probe`` best cells of each query token (all, if there are fewer).

    With ``allowed`` (query_id, codes), only among those cells; queries without any are dropped.
    """
    shared = queries.sparkSession.sparkContext.broadcast(centroids)
    rows = queries.select("query_id", "vectors")
    rows = rows.join(allowed, "query_id") if allowed is not None else rows.withColumn("codes", F.lit(None).cast("array<int>"))

    def work(batches):
        for batch in batches:
            ids, cells = [], []
            x, ends = dense.ragged(batch.column(1))
            for row, (q, codes) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                codes = np.arange(len(shared.value)) if codes is None else np.sort(np.array(codes, np.int64))
                if ends[row + 1] == ends[row] or not len(codes):
                    continue
                s = np.round(x[ends[row] : ends[row + 1]] @ shared.value[codes].T, DIGITS)
                p = min(n_probe, len(codes))
                best = np.argsort(-s, axis=1, kind="stable")[:, :p] if p < len(codes) else np.arange(len(codes))[None]
                found = np.unique(codes[best])
                ids += [q] * len(found)
                cells.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(cells) if cells else [], pa.int32())], ["query_id", "code"])

    return rows.select("query_id", "vectors", "codes").mapInArrow(work, "query_id long, code int")


def candidates(probes: DataFrame, ivf: DataFrame) -> DataFrame:
    """Distinct (query_id, doc_id) of documents in probed cells."""
    return probes.join(ivf, "code").select("query_id", "doc_id").distinct()


def restrict(found: DataFrame, subset: DataFrame) -> DataFrame:
    """Candidates that are in the subset, (query_id, doc_id) or (doc_id) for all queries."""
    keys = ["query_id", "doc_id"] if "query_id" in subset.columns else ["doc_id"]
    return found.join(subset.select(*keys).distinct(), keys, "left_semi")


def subset_codes(encoded: DataFrame, subset: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, codes): the cells that a query's subset touches."""
    if "query_id" not in subset.columns:
        cells = encoded.join(subset.select("doc_id").distinct(), "doc_id", "left_semi").select(F.explode(F.array_distinct("codes")).alias("code")).distinct()
        return queries.select("query_id").join(F.broadcast(cells.agg(F.collect_list("code").alias("codes"))))
    cells = encoded.join(subset.select("query_id", "doc_id").distinct(), "doc_id").select("query_id", F.explode(F.array_distinct("codes")).alias("code"))
    return cells.groupBy("query_id").agg(F.collect_set("code").alias("codes"))


def approximate(found: DataFrame, encoded: DataFrame, centroids: np.ndarray, queries: dict[int, np.ndarray]) -> DataFrame:
    """(query_id, doc_id, score): MaxSim with each token's centroid in its place."""
    shared = found.sparkSession.sparkContext.broadcast((centroids, queries))
    rows = found.join(encoded.select("doc_id", "codes"), "doc_id").select("query_id", "doc_id", "codes")

    def work(batches):
        centroids, queries = shared.value
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            codes, ends = codes_of(batch.column(2))
            size = np.diff(ends)
            out = np.zeros(len(ids))
            for q in np.unique(ids):
                if q not in tables:
                    if sum(t.size for t in tables.values()) > dense.BLOCK:
                        tables.clear()
                    tables[q] = centroids @ queries[q].T
                rows = np.flatnonzero((ids == q) & (size > 0))
                if len(rows):
                    at = np.repeat(ends[:-1][rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(size[rows].sum())
                    out[rows] = dense.maxsim(tables[q][codes[at]], np.cumsum(size[rows]) - size[rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(out, DIGITS))], ["query_id", "doc_id", "score"])

    return rows.mapInArrow(work, "query_id long, doc_id long, score double")


def rerank(kept: DataFrame, encoded: DataFrame, codec: Codec, queries: dict[int, np.ndarray], matrices: bool = False, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, score[, token_scores]): exact MaxSim against reconstructed vectors.

    ``most`` is a proven bound on the rows of ``kept``; if it is small, they are sent to the documents.
    """
    shared = kept.sparkSession.sparkContext.broadcast((codec, queries))
    pairs = kept.select("query_id", "doc_id")
    if most is not None and most <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    rows = pairs.join(encoded.select("doc_id", "codes", "residuals"), "doc_id").select("query_id", "doc_id", "codes", "residuals")

    def work(batches):
        codec, queries = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                codes, ends = codes_of(part.column(2))
                x = dense.reconstruct(codes, packed_of(part.column(3)), codec.centroids, codec.weights, codec.nbits)
                scores, tables = [], []
                for row, q in enumerate(part.column(0).to_pylist()):
                    s = queries[q] @ x[ends[row] : ends[row + 1]].T
                    scores.append(round(float(s.max(1).sum()), DIGITS) if s.size else 0.0)
                    if matrices:
                        tables.append(s.tolist())
                arrays = [part.column(0), part.column(1), pa.array(scores, pa.float64())]
                names = ["query_id", "doc_id", "score"]
                if matrices:
                    arrays.append(pa.array(tables, pa.list_(pa.list_(pa.float64()))))
                    names.append("token_scores")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "query_id long, doc_id long, score double" + (", token_scores array<array<double>>" if matrices else "")
    return rows.mapInArrow(work, schema)


def search(queries: DataFrame, encoded: DataFrame, ivf: DataFrame, codec: Codec, params: Params | None = None, subset: DataFrame | None = None, matrices: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score[, token_scores]) for all queries."""
    params = params or Params()
    parts = []
    everything = collect_queries(queries)
    for batch in query_batches(everything):
        own = queries if len(batch) == len(everything) else queries.filter(F.col("query_id").isin(list(batch)))
        allowed = subset_codes(encoded, subset, own) if subset is not None else None
        found = candidates(probe(own, codec.centroids, params.n_ivf_probe, allowed), ivf)
        if subset is not None:
            found = restrict(found, subset)
        rough = approximate(found, encoded, codec.centroids, batch)
        best = rank(rough, params.reranked)
        exact = rerank(best, encoded, codec, batch, most=len(batch) * params.reranked)
        top = rank(exact, params.top_k)
        if matrices:
            tables = rerank(top, encoded, codec, batch, matrices=True, most=len(batch) * params.top_k).drop("score")
            top = top.join(tables, ["query_id", "doc_id"])
        parts.append(top.select("query_id", "rank", "doc_id", "score", *(["token_scores"] if matrices else [])))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _floors(found: DataFrame, documents: DataFrame, queries: dict[int, np.ndarray], top_k: int) -> dict[int, float]:
    """The exact score of the ``top_k``-th of ``found`` for each query that has as many; the true one isn't lower."""
    scored = rank(maxsim_pairs(found.select("query_id", "doc_id").join(documents, "doc_id"), queries), top_k)
    last = scored.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    return {r["query_id"]: r["low"] for r in last.collect() if r["n"] == top_k}


def at_least(documents: DataFrame, encoded: DataFrame, centroids: np.ndarray, queries: dict[int, np.ndarray], floors: dict[int, float], top_k: int, subset: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) on raw vectors: of each task the ``top_k`` best documents that reach their query's floor.

    A token is at most as near as its centroid plus the length of its residual, so a document whose tokens
    stay below the floor by that bound isn't scored.
    """
    shared = documents.sparkSession.sparkContext.broadcast((centroids, queries, floors))
    rows = documents.select("doc_id", "vectors").join(encoded.select("doc_id", "codes"), "doc_id")
    if subset is None:
        rows = rows.withColumn("asked", F.lit(None).cast("array<bigint>"))
    elif "query_id" in subset.columns:
        rows = rows.join(subset.groupBy("doc_id").agg(F.collect_set("query_id").alias("asked")), "doc_id")
    else:
        rows = rows.join(subset.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("asked", F.lit(None).cast("array<bigint>"))

    def work(batches):
        centroids, queries, floors = shared.value
        order = np.array(sorted(q for q in queries if len(queries[q])), np.int64)
        if not len(order):
            return
        stacked = np.concatenate([queries[q] for q in order])
        first = np.concatenate([[0], np.cumsum([len(queries[q]) for q in order])])[:-1]
        low = np.array([floors.get(q, -np.inf) for q in order]) - 2 * 10.0**-DIGITS
        length, near = np.linalg.norm(stacked, axis=1), centroids @ stacked.T
        total = lambda table, begin: np.add.reduceat(np.maximum.reduceat(table, begin, axis=0), first, axis=1)
        top, at = np.full((0, len(order)), -np.inf), np.zeros((0, len(order)), np.int64)
        for batch in batches:
            step = max(1, dense.BLOCK // max(len(stacked) * 32, 1))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                part = part.filter(pa.array([n > 0 for n in pa.compute.list_value_length(part.column(1)).to_pylist()], pa.bool_()))
                if not part.num_rows:
                    continue
                x, ends = dense.ragged(part.column(1))
                codes, _ = codes_of(part.column(2))
                far = np.linalg.norm(x - centroids[codes], axis=1)
                wanted = total(near[codes] + far[:, None] * length, ends[:-1]) >= low
                for row, asked in enumerate(part.column(3).to_pylist()):
                    if asked is not None:
                        wanted[row] &= np.isin(order, asked)
                some = np.flatnonzero(wanted.any(1))
                if not len(some):
                    continue
                size = np.diff(ends)
                inside = np.repeat(wanted.any(1), size)
                score = np.round(total(x[inside] @ stacked.T, np.cumsum(size[some]) - size[some]), DIGITS)
                score[~wanted[some] | (score < low)] = -np.inf
                docs = np.repeat(np.asarray(part.column(0))[some][:, None], len(order), axis=1)
                top, at = np.concatenate([top, score]), np.concatenate([at, docs])
                best = np.lexsort((at, -top), axis=0)[:top_k]
                top, at = np.take_along_axis(top, best, 0), np.take_along_axis(at, best, 0)
        i, j = np.nonzero(top > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(order[j]), pa.array(at[i, j]), pa.array(top[i, j])], ["query_id", "doc_id", "score"])

    return rows.select("doc_id", "vectors", "codes", "asked").mapInArrow(work, "query_id long, doc_id long, score double")


def raw_token_scores(top: DataFrame, documents: DataFrame, queries: dict[int, np.ndarray]) -> DataFrame:
    """``top`` with ``token_scores``, the matrix of dot products with the document's raw vectors."""
    shared = top.sparkSession.sparkContext.broadcast(queries)

    def work(batches):
        for batch in batches:
            x, ends = dense.ragged(batch.column(4))
            tables = [(shared.value[q] @ x[ends[row] : ends[row + 1]].T).tolist() for row, q in enumerate(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(tables, pa.list_(pa.list_(pa.float64())))], ["query_id", "rank", "doc_id", "score", "token_scores"])

    rows = top.join(documents, "doc_id").select("query_id", "rank", "doc_id", "score", "vectors")
    return rows.mapInArrow(work, "query_id long, rank int, doc_id long, score double, token_scores array<array<double>>")


def search_complete(queries: DataFrame, documents: DataFrame, encoded: DataFrame, ivf: DataFrame, codec: Codec, params: Params | None = None, subset: DataFrame | None = None, matrices: bool = False) -> DataFrame:
    """The true top k on raw vectors, with columns as of ``search``: what the staged search finds tells from which score on."""
    params = params or Params()
    found, parts = search(queries, encoded, ivf, codec, params, subset), []
    batches = query_batches(collect_queries(queries))
    for batch in batches:
        own = found if len(batches) == 1 else found.filter(F.col("query_id").isin(list(batch)))
        floors = _floors(own, documents, batch, params.top_k)
        top = rank(at_least(documents, encoded, codec.centroids, batch, floors, params.top_k, subset), params.top_k)
        top = top.select("query_id", "rank", "doc_id", "score")
        parts.append(raw_token_scores(top, documents, batch) if matrices else top)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def token_score_rows(found: DataFrame) -> DataFrame:
    """(query_id, doc_id, qpos, pos, sim) from results with ``token_scores``."""
    return found.select("query_id", "doc_id", F.posexplode("token_scores").alias("qpos", "row")).select("query_id", "doc_id", "qpos", F.posexplode("row").alias("pos", "sim"))


def get_embeddings(encoded: DataFrame, codec: Codec, subset: DataFrame) -> DataFrame:
    """(ord, doc_id, vectors) of the wanted documents (ord, doc_id), repeats kept."""
    from .codec import decode

    return decode(subset.join(encoded, "doc_id").select("ord", "doc_id", "codes", "residuals"), codec)
