"""The index as one object: create, update, delete, search, reconstruct."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import codec as codecs
from mosaiq.operators import ivf as inverted
from mosaiq.operators import kmeans, metadata, mutate
from mosaiq.operators import search as searching
from mosaiq.operators.codec import Codec
from mosaiq.sources.snapshots import Snapshots
from mosaiq.sources.token_rows import as_documents, as_queries

from .workspace import Workspace, dense_names

#: Up to so many documents an index keeps raw vectors and is rebuilt by an update.
START_FROM_SCRATCH = 999
#: Appended documents that wait before outliers get centroids of their own.
BUFFER_SIZE = 100


class State:
    """One version of an index, resolved once."""

    def __init__(self, store: Snapshots, version: int):
        self.store = store
        self.manifest = store.manifest(version)
        self._codec: Codec | None = None

    def table(self, name: str) -> DataFrame:
        return self.store.table(self.manifest, name)

    def has(self, name: str) -> bool:
        return bool(self.manifest["tables"].get(name))

    @property
    def codec(self) -> Codec:
        if self._codec is None:
            rows = self.table("centroids").orderBy("code").select("cv").collect()
            m = self.manifest
            self._codec = Codec(m["nbits"], np.array([r["cv"] for r in rows], np.float64), np.array(m["cutoffs"]), np.array(m["weights"]), np.array(m["avg_residual"]), m["cluster_threshold"])
        return self._codec


def _numbered(ws: Workspace, documents: DataFrame, start: int) -> DataFrame:
    """Documents under dense numbers from ``start`` on, in the order of the ids they came with."""
    numbers = dense_names(ws, documents, ["doc_id"], "numbers", "_n")
    return documents.join(numbers, "doc_id").select((F.col("_n") + start).alias("doc_id"), "vectors")


class MultiVectorIndex:
    """A compressed multi-vector index in a folder of versioned snapshots."""

    def __init__(self, spark: SparkSession, path: str, ordered: bool = False):
        """``ordered``: k-means starts from the first tokens by (document, position), not from a seeded choice."""
        self.spark, self.path = spark, path
        self.order = [F.col("doc_id"), F.col("pos")] if ordered else None
        self.store = Snapshots(spark, path)
        self._state: State | None = None

    # -- reading ------------------------------------------------------------------------------------

    def state(self) -> State:
        version = self.store.current()
        if version is None:
            raise FileNotFoundError(f"no index in {self.path}")
        if self._state is None or self._state.manifest["version"] != version:
            self._state = State(self.store, version)
        return self._state

    def close(self) -> None:
        self._state = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _subset(self, queries: DataFrame, subset, strict: bool) -> DataFrame | None:
        """A subset in any accepted form as (doc_id) or (query_id, doc_id); an empty flat one means all unless ``strict``."""
        if subset is None or isinstance(subset, DataFrame):
            return subset
        if isinstance(subset, int):
            subset = [subset]
        subset = list(subset)
        if not subset and not strict:
            return None
        if subset and isinstance(subset[0], (list, tuple, set, range, np.ndarray)):
            ids = [r[0] for r in queries.select("query_id").orderBy("query_id").collect()]
            if len(ids) != len(subset):
                raise ValueError(f"{len(subset)} subsets for {len(ids)} queries")
            pairs = [(q, int(d)) for q, own in zip(ids, subset) for d in own]
            return self.spark.createDataFrame(pairs, "query_id long, doc_id long")
        return self.spark.createDataFrame([(int(d),) for d in subset], "doc_id long")

    def _search(self, queries, top_k, n_full_scores, n_ivf_probe, subset, strict_subset, matrices) -> DataFrame:
        state = self.state()
        if state.manifest["compress_only"]:
            raise ValueError("this index was made with compress_only and can't be searched")
        asked = as_queries(self.spark, queries)
        params = searching.Params(top_k, n_full_scores, n_ivf_probe)
        within = self._subset(asked, subset, strict_subset)
        return searching.search(asked, state.table("encoded"), state.table("ivf"), state.codec, params, within, matrices)

    def search(self, queries, top_k: int = 10, n_full_scores: int = 4096, n_ivf_probe: int = 8, subset=None, strict_subset: bool = False) -> DataFrame:
        """(query_id, rank, doc_id, score). ``subset``: numbers, one list a query, or a DataFrame with doc_id."""
        return self._search(queries, top_k, n_full_scores, n_ivf_probe, subset, strict_subset, False)

    def search_token_scores(self, queries, top_k: int = 10, n_full_scores: int = 4096, n_ivf_probe: int = 8, subset=None, strict_subset: bool = False) -> DataFrame:
        """As ``search``, with the matrix of query and document tokens of each hit."""
        return self._search(queries, top_k, n_full_scores, n_ivf_probe, subset, strict_subset, True)

    def get_embeddings(self, subset: int | Sequence[int] | DataFrame) -> DataFrame:
        """(ord, doc_id, vectors) of these documents, in order, repeats kept."""
        if not isinstance(subset, DataFrame):
            ids = [subset] if isinstance(subset, int) else list(subset)
            subset = self.spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "ord long, doc_id long")
        state = self.state()
        return searching.get_embeddings(state.table("encoded"), state.codec, subset)

    # -- metadata -----------------------------------------------------------------------------------

    def _metadata(self) -> DataFrame:
        state = self.state()
        if not state.has("metadata"):
            raise FileNotFoundError(f"no metadata in {self.path}")
        return state.table("metadata")

    def where(self, condition: str, parameters: Sequence = ()) -> DataFrame:
        """(doc_id) of documents that meet a SQL condition; give it to ``search`` as ``subset``."""
        return metadata.where(self._metadata(), condition, parameters)

    def get(self, condition: str | None = None, parameters: Sequence = (), subset=None) -> DataFrame:
        return metadata.get(self._metadata(), condition, parameters, subset)

    # -- writing ------------------------------------------------------------------------------------

    def _commit(self, write, keep, codec: Codec, compress_only: bool, counts: tuple[int, int, int], batches: dict[str, int]) -> None:
        documents, tokens, longest = counts
        manifest = {
            "num_documents": documents, "num_embeddings": tokens, "avg_doclen": tokens / documents if documents else 0.0,
            "num_partitions": len(codec.centroids), "nbits": codec.nbits, "dim": codec.dim, "compress_only": compress_only,
            "cutoffs": codec.cutoffs.tolist(), "weights": codec.weights.tolist(), "avg_residual": codec.avg_residual.tolist(),
            "cluster_threshold": codec.cluster_threshold, "max_doclen": longest, "batches": batches,
        }
        self.store.commit(write, keep, manifest, {"encoded": "doc_id", "ivf": "code"})
        self._state = None

    def _centroid_table(self, codec: Codec) -> DataFrame:
        return self.spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(codec.centroids)], "code int, cv array<double>")

    @staticmethod
    def _counts(documents: DataFrame, column: str = "vectors") -> tuple[int, int, int]:
        """Documents, tokens and the greatest number of tokens of a document."""
        size = F.size(column)
        return tuple(documents.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first())

    def create(self, documents, kmeans_niters: int = 4, max_points_per_centroid: int = 256, nbits: int = 4, n_samples_kmeans: int | None = None, seed: int = 42, metadata_rows=None, start_from_scratch: int = START_FROM_SCRATCH, compress_only: bool = False, n_centroids: int | None = None, codec: Codec | None = None, batch: tuple[str, int] | None = None) -> MultiVectorIndex:
        """A new index; whatever is in the folder becomes an older version. Numbers are dense, in order of ``doc_id``.

        ``codec``: a codebook that was trained elsewhere, instead of one for these documents.
        """
        with self.store.lock():
            ws = Workspace(self.spark, "create")
            docs = ws.save(_numbered(ws, as_documents(self.spark, documents), 0), "documents")
            self._build(ws, docs, kmeans_niters, max_points_per_centroid, nbits, n_samples_kmeans, seed, metadata_rows, start_from_scratch, compress_only, n_centroids, codec, dict([batch] if batch else []))
        return self

    def _build(self, ws, docs, iterations, max_points, nbits, n_samples, seed, metadata_rows, scratch, compress_only, k, codec, batches) -> None:
        n, tokens, longest = self._counts(docs)
        if not tokens:
            raise ValueError("an index needs at least one token")
        dim = docs.filter(F.size("vectors") > 0).select(F.size(F.col("vectors")[0])).first()[0]
        codecs.check_layout(nbits, dim)
        write = {}
        if metadata_rows is not None:
            table = metadata.create(metadata_rows, self.spark)
            if table.count() != n:
                raise ValueError(f"{table.count()} metadata rows for {n} documents")
            write["metadata"] = table
        if codec is None:
            centroids = kmeans.codebook(docs, iterations, max_points, n_samples, seed, k, self.order)
            sample = kmeans.sample_documents(docs, kmeans.sample_size(n), n, seed)
            codec = codecs.train(sample.select("doc_id", F.posexplode("vectors").alias("pos", "v")), centroids, nbits)
        encoded = ws.save(codecs.encode(docs, codec), "encoded")
        write |= {"centroids": self._centroid_table(codec), "encoded": encoded}
        if not compress_only:
            write["ivf"] = inverted.build(encoded)
        if n <= scratch:
            write["raw"] = docs
        self._commit(write, {}, codec, compress_only, (n, tokens, longest), batches)

    def update(self, documents, metadata_rows: Sequence[Mapping] | DataFrame | None = None, kmeans_niters: int = 4, max_points_per_centroid: int = 256, nbits: int = 4, n_samples_kmeans: int | None = None, seed: int = 42, start_from_scratch: int = START_FROM_SCRATCH, buffer_size: int = BUFFER_SIZE, n_centroids: int | None = None, batch: tuple[str, int] | None = None) -> MultiVectorIndex:
        """Append documents: rebuild a small index, else append, with new centroids for outliers every ``buffer_size`` documents.

        ``batch`` (name of a stream, number) is committed with the documents; a number that isn't above the
        stream's last one was appended before and does nothing.
        """
        if self.store.current() is None:
            return self.create(documents, kmeans_niters, max_points_per_centroid, nbits, n_samples_kmeans, seed, metadata_rows, start_from_scratch, n_centroids=n_centroids, batch=batch)
        with self.store.lock():
            self._state = None
            state, ws = self.state(), Workspace(self.spark, "update")
            m = state.manifest
            batches = m.get("batches", {})
            if batch is not None:
                if batch[1] <= batches.get(batch[0], -1):
                    return self
                batches = batches | {batch[0]: batch[1]}
            start = m["num_documents"]
            new = ws.save(_numbered(ws, as_documents(self.spark, documents), start), "documents")
            n, tokens, longest = self._counts(new)
            about = self._appended_metadata(state, metadata_rows, n)
            if not n:
                return self
            if start <= start_from_scratch and state.has("raw"):
                both = ws.save(state.table("raw").unionByName(new), "both")
                whole = metadata.update(state.table("metadata"), about) if about is not None else None
                self._build(ws, both, kmeans_niters, max_points_per_centroid, m["nbits"], n_samples_kmeans, seed, whole, start_from_scratch, m["compress_only"], n_centroids, None, batches)
                return self
            keep = {k: v for k, v in m["tables"].items() if k != "raw"}
            write = {}
            if about is not None:
                write["metadata"] = self._only_new(state.table("metadata"), about)
            waiting = state.table("buffer") if state.has("buffer") else None
            pending = n + (waiting.count() if waiting is not None else 0)
            codec = state.codec
            if pending < buffer_size:
                encoded = ws.save(codecs.encode(new, codec), "encoded")
                write |= {"encoded": encoded, "buffer": new}
                if not m["compress_only"]:
                    write["ivf"] = inverted.build(encoded)
            else:
                flushed = ws.save(new if waiting is None else waiting.unionByName(new), "flushed")
                old = state.table("encoded") if waiting is None else state.table("encoded").join(waiting.select("doc_id"), "doc_id", "left_anti")
                vectors = flushed.select("doc_id", F.posexplode("vectors").alias("pos", "v"))
                grown = mutate.expand(vectors, codec.centroids, codec.cluster_threshold, kmeans_niters, max_points_per_centroid, seed, self.order)
                codec = Codec(codec.nbits, grown, codec.cutoffs, codec.weights, codec.avg_residual, codec.cluster_threshold)
                fresh = codecs.cluster_threshold(codecs.residuals(kmeans.assign(vectors, grown, "dot"), grown))
                n_flushed = vectors.count()
                codec.cluster_threshold = mutate.merge_thresholds(codec.cluster_threshold, m["num_embeddings"] + tokens - n_flushed, fresh, n_flushed)
                encoded = ws.save(codecs.encode(flushed, codec), "encoded")
                keep.pop("centroids")
                keep.pop("buffer", None)
                write["centroids"] = self._centroid_table(codec)
                if waiting is None:
                    write["encoded"] = encoded
                else:
                    keep.pop("encoded")
                    write["encoded"] = old.unionByName(encoded)
                if not m["compress_only"]:
                    if waiting is not None:
                        keep.pop("ivf")
                    write["ivf"] = inverted.build(write["encoded"])
            longest = max(longest, m.get("max_doclen", 0))
            self._commit(write, keep, codec, m["compress_only"], (start + n, m["num_embeddings"] + tokens, longest), batches)
        return self

    def _appended_metadata(self, state: State, rows, n: int):
        """Checked metadata for appended documents; empty rows where the index has metadata and none is given."""
        if not state.has("metadata"):
            return None
        if rows is None:
            return [{} for _ in range(n)]
        given = rows.count() if isinstance(rows, DataFrame) else len(rows)
        if given != n:
            raise ValueError(f"{given} metadata rows for {n} documents")
        return rows

    def _only_new(self, table: DataFrame, rows) -> DataFrame:
        start = table.agg(F.coalesce(F.max(metadata.KEY), F.lit(-1))).first()[0]
        return metadata.update(table, rows).filter(F.col(metadata.KEY) > start)

    def delete(self, subset: int | Sequence[int] | DataFrame) -> MultiVectorIndex:
        """Remove documents and renumber the rest without gaps; unknown numbers are ignored."""
        with self.store.lock():
            self._state = None
            state, ws = self.state(), Workspace(self.spark, "delete")
            m = state.manifest
            if not isinstance(subset, DataFrame):
                ids = [subset] if isinstance(subset, int) else sorted({int(i) for i in subset})
                subset = self.spark.createDataFrame([(i,) for i in ids], "doc_id long")
            numbers = ws.save(mutate.renumber(ws, state.table("encoded"), subset), "mapping")
            encoded = ws.save(mutate.apply_numbers(state.table("encoded"), numbers), "encoded")
            write = {"encoded": encoded}
            for name in ("raw", "buffer"):
                if state.has(name):
                    write[name] = mutate.apply_numbers(state.table(name), numbers)
            if state.has("metadata"):
                write["metadata"] = mutate.apply_numbers(state.table("metadata"), numbers, metadata.KEY)
            if not m["compress_only"]:
                write["ivf"] = inverted.build(encoded)
            self._commit(write, {"centroids": m["tables"]["centroids"]}, state.codec, m["compress_only"], self._counts(encoded, "codes"), m.get("batches", {}))
        return self


def to_lists(results: DataFrame, queries: int | None = None) -> list[list[tuple[int, float]]]:
    """Results as one list of (doc_id, score) a query, for small outputs."""
    rows = results.select("query_id", "rank", "doc_id", "score").orderBy("query_id", "rank").collect()
    n = queries if queries is not None else 1 + max((r["query_id"] for r in rows), default=-1)
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for r in rows:
        out[r["query_id"]].append((r["doc_id"], r["score"]))
    return out
