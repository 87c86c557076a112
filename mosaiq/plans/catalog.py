"""Every operator as a query over the supplied tables.

Multi-vector documents are made of the rows of ``embeddings``: each run of 15 vectors is five documents
of 1 to 5 tokens. Queries are all documents whose id is divisible by 20. The codebook is k-means with 16 centroids and
two steps from the first 16 vectors, so that every stage can be compared with plain SQL.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import dense, vectors
from mosaiq.operators import codec as codecs
from mosaiq.operators import evaluation, ivf, kmeans, metadata, mutate, search
from mosaiq.sources.token_rows import nested, query_rows

from .index import MultiVectorIndex
from .workspace import Workspace, prefix_sums

K, STEPS, NBITS, PROBE, N_FULL, TOP_K = 16, 2, 2, 2, 80, 10
PARAMS = search.Params(TOP_K, N_FULL, PROBE)
#: Every document whose id is divisible by this is a query.
QUERY_STEP = 20


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, v, label)."""
    r = F.col("vec_id") % 15
    place = sum((r >= n).cast("int") for n in (1, 3, 6, 10))
    start = F.element_at(F.array(*map(F.lit, (0, 1, 3, 6, 10))), place + 1)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(
        (F.floor(F.col("vec_id") / 15) * 5 + place).cast("long").alias("doc_id"), (r - start).cast("int").alias("pos"), F.col("embedding").alias("v"), "label"
    )


def tokens(spark, sf_dir) -> DataFrame:
    return token_table(spark, sf_dir).select("doc_id", "pos", "v")


def documents(spark, sf_dir) -> DataFrame:
    return nested(tokens(spark, sf_dir))


def query_table(spark, sf_dir) -> DataFrame:
    """(query_id, vectors)."""
    return documents(spark, sf_dir).filter(F.col("doc_id") % QUERY_STEP == 0).withColumnRenamed("doc_id", "query_id")


def order():
    return [F.col("doc_id"), F.col("pos")]


@lru_cache(maxsize=8)
def _codebook(app: str, sf_dir: str) -> np.ndarray:
    spark = SparkSession.getActiveSession()
    return dense.unit(kmeans.train(tokens(spark, sf_dir), K, STEPS, order=order()))


@lru_cache(maxsize=8)
def _codec(app: str, sf_dir: str) -> codecs.Codec:
    spark = SparkSession.getActiveSession()
    return codecs.train(tokens(spark, sf_dir), _codebook(app, sf_dir), NBITS)


def codebook(spark, sf_dir) -> np.ndarray:
    return _codebook(spark.sparkContext.applicationId, sf_dir)


def codec(spark, sf_dir) -> codecs.Codec:
    return _codec(spark.sparkContext.applicationId, sf_dir)


def matrix_rows(spark, matrix: np.ndarray, name: str = "cv") -> DataFrame:
    """(code, cv rounded) of a driver-side codebook."""
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(matrix)], f"code int, {name} array<double>")
    return rows.withColumn(name, vectors.rounded(F.col(name)))


def rounded(df: DataFrame, column: str = "score") -> DataFrame:
    return df.withColumn(column, F.round(column, 6) + F.lit(0.0))


# -- sources -------------------------------------------------------------------------------------------


def scan_token_rows(spark, sf_dir):
    return tokens(spark, sf_dir).select("doc_id", "pos", vectors.rounded(vectors.doubles(F.col("v"))).alias("v"))


def query_explode(spark, sf_dir):
    rows = query_rows(query_table(spark, sf_dir))
    return rows.select("query_id", "qpos", vectors.rounded(vectors.doubles(F.col("qv"))).alias("qv"))


def doc_lengths(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("length"))


def doc_offsets(spark, sf_dir):
    return prefix_sums(Workspace(spark, "offsets"), doc_lengths(spark, sf_dir), "doc_id", "length", "lengths").select("doc_id", "offset")


def index_stats(spark, sf_dir):
    return rounded(ivf.stats(encoded(spark, sf_dir)), "avg_doclen")


def index_manifest(spark, sf_dir):
    """The numbers that an index on disk keeps of its documents."""
    m = _index(spark, sf_dir, "manifest", documents(spark, sf_dir), start_from_scratch=0).state().manifest
    names = ["num_documents", "num_embeddings", "num_partitions", "dim", "max_doclen"]
    return spark.createDataFrame([tuple(int(m[n]) for n in names)], ", ".join(f"{n} long" for n in names))


# -- exact search ----------------------------------------------------------------------------------------


def _queries(spark, sf_dir):
    return search.collect_queries(query_table(spark, sf_dir))


def maxsim_bruteforce(spark, sf_dir):
    return rounded(search.bruteforce(documents(spark, sf_dir), _queries(spark, sf_dir)))


def maxsim_relational(spark, sf_dir):
    rows = query_rows(query_table(spark, sf_dir))
    return rounded(search.maxsim_sql(tokens(spark, sf_dir), rows))


def search_topk_exact(spark, sf_dir):
    found = search.bruteforce_topk(documents(spark, sf_dir), _queries(spark, sf_dir), TOP_K)
    return rounded(found).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


# -- codebook --------------------------------------------------------------------------------------------


def _sizes(spark, sf_dir):
    return tokens(spark, sf_dir).agg(F.countDistinct("doc_id"), F.count("*")).first()


def num_partitions(spark, sf_dir):
    n, t = _sizes(spark, sf_dir)
    return spark.createDataFrame([(n, t, kmeans.partition_count(n, t / n))], "num_documents long, num_embeddings long, num_partitions long")


def kmeans_sample_size(spark, sf_dir):
    n, _ = _sizes(spark, sf_dir)
    return spark.createDataFrame([(n, kmeans.sample_size(n))], "num_documents long, sample_size long")


def kmeans_init(spark, sf_dir):
    return matrix_rows(spark, kmeans.seeds(tokens(spark, sf_dir), K, order=order()))


def kmeans_assign(spark, sf_dir):
    first = kmeans.seeds(tokens(spark, sf_dir), K, order=order())
    return kmeans.assign(tokens(spark, sf_dir), first).select("doc_id", "pos", "code")


def kmeans_assign_relational(spark, sf_dir):
    first = kmeans.seeds(tokens(spark, sf_dir), K, order=order())
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(first)], "code int, cv array<double>")
    return kmeans.assign_sql(tokens(spark, sf_dir), table).select("doc_id", "pos", "code")


def kmeans_update(spark, sf_dir):
    first = kmeans.seeds(tokens(spark, sf_dir), K, order=order())
    return matrix_rows(spark, kmeans.step(tokens(spark, sf_dir), first))


def kmeans_centroids(spark, sf_dir):
    return matrix_rows(spark, codebook(spark, sf_dir))


def l2_normalize(spark, sf_dir):
    return tokens(spark, sf_dir).select("doc_id", "pos", vectors.rounded(vectors.normalize(F.col("v"))).alias("v"))


# -- codec -----------------------------------------------------------------------------------------------


def assigned(spark, sf_dir):
    return kmeans.assign(tokens(spark, sf_dir), codebook(spark, sf_dir), "dot")


def assign_codes(spark, sf_dir):
    return assigned(spark, sf_dir).select("doc_id", "pos", "code")


def residuals(spark, sf_dir):
    rows = codecs.residuals(assigned(spark, sf_dir), codebook(spark, sf_dir))
    return rows.select("doc_id", "pos", vectors.rounded(F.col("r")).alias("r"))


def heldout_tokens(spark, sf_dir):
    return codecs.held_out(tokens(spark, sf_dir)).select("doc_id", "pos")


def _values(spark, values) -> DataFrame:
    rows = spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "i int, value double")
    return rounded(rows, "value")


def bucket_cutoffs(spark, sf_dir):
    return _values(spark, codec(spark, sf_dir).cutoffs)


def bucket_weights(spark, sf_dir):
    return _values(spark, codec(spark, sf_dir).weights)


def cluster_threshold(spark, sf_dir):
    return _values(spark, [codec(spark, sf_dir).cluster_threshold])


def avg_residual(spark, sf_dir):
    return _values(spark, codec(spark, sf_dir).avg_residual)


def encoded(spark, sf_dir) -> DataFrame:
    return codecs.encode(documents(spark, sf_dir), codec(spark, sf_dir))


def bucketize(spark, sf_dir):
    """Bucket numbers by column expressions."""
    own = codec(spark, sf_dir)
    rows = codecs.residuals(assigned(spark, sf_dir), own.centroids)
    cuts = [float(c) for c in own.cutoffs]
    return rows.select("doc_id", "pos", F.transform("r", lambda x: vectors.bucket(x, cuts)).alias("buckets"))


def pack_residuals(spark, sf_dir):
    """Bucket numbers by the packing kernel, unpacked again."""
    return codecs.bucket_rows(encoded(spark, sf_dir), codec(spark, sf_dir))


def reconstruct(spark, sf_dir):
    rows = codecs.decode(encoded(spark, sf_dir), codec(spark, sf_dir))
    return rows.select("doc_id", F.posexplode("vectors").alias("pos", "v")).withColumn("v", vectors.rounded(vectors.doubles(F.col("v")), 3))


def get_embeddings(spark, sf_dir):
    subset = spark.createDataFrame(list(enumerate([5, 2, 5, 99_999_999, 0])), "ord long, doc_id long")
    rows = search.get_embeddings(encoded(spark, sf_dir), codec(spark, sf_dir), subset)
    return rows.select("ord", "doc_id", F.posexplode("vectors").alias("pos", "v")).withColumn("v", vectors.rounded(vectors.doubles(F.col("v")), 3))


# -- inverted file ---------------------------------------------------------------------------------------


def ivf_build(spark, sf_dir):
    return ivf.build(encoded(spark, sf_dir)).select("code", "doc_id")


def ivf_lengths(spark, sf_dir):
    return ivf.lengths(ivf_build(spark, sf_dir), K)


def ivf_merge(spark, sf_dir):
    rows = encoded(spark, sf_dir)
    merged = ivf.merge(ivf.build(rows.filter("doc_id < 100")), ivf.build(rows.filter("doc_id >= 100")))
    return ivf.lengths(merged, K)


# -- search ----------------------------------------------------------------------------------------------


def centroid_scores(spark, sf_dir):
    rows = search.centroid_scores(query_rows(query_table(spark, sf_dir)), codebook(spark, sf_dir))
    return rounded(rows)


def ivf_probe(spark, sf_dir):
    return search.probe(query_table(spark, sf_dir), codebook(spark, sf_dir), PROBE)


def candidates(spark, sf_dir):
    return search.candidates(ivf_probe(spark, sf_dir), ivf_build(spark, sf_dir))


def _approximate(spark, sf_dir):
    return search.approximate(candidates(spark, sf_dir), encoded(spark, sf_dir), codebook(spark, sf_dir), _queries(spark, sf_dir))


def approx_scores(spark, sf_dir):
    return rounded(_approximate(spark, sf_dir))


def prune_stage1(spark, sf_dir):
    return search.rank(_approximate(spark, sf_dir), N_FULL).select("query_id", "doc_id")


def prune_stage2(spark, sf_dir):
    return search.rank(_approximate(spark, sf_dir), PARAMS.reranked).select("query_id", "doc_id")


def exact_rerank(spark, sf_dir):
    return rounded(search.rerank(prune_stage2(spark, sf_dir), encoded(spark, sf_dir), codec(spark, sf_dir), _queries(spark, sf_dir)))


def _search(spark, sf_dir, subset=None, matrices=False, params=PARAMS):
    rows = encoded(spark, sf_dir)
    return search.search_complete(query_table(spark, sf_dir), documents(spark, sf_dir), rows, ivf.build(rows), codec(spark, sf_dir), params, subset, matrices)


def _results(found):
    return rounded(found).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def search_topk(spark, sf_dir):
    return _results(_search(spark, sf_dir))


def token_scores(spark, sf_dir):
    return rounded(search.token_score_rows(_search(spark, sf_dir, matrices=True)), "sim")


def _thirds(spark, sf_dir):
    return documents(spark, sf_dir).filter("doc_id % 3 = 0").select("doc_id")


def _own_subsets(spark, sf_dir):
    ids = documents(spark, sf_dir).select("doc_id")
    return query_table(spark, sf_dir).select("query_id").join(ids, F.col("doc_id") % 4 == F.col("query_id") % 4)


def ivf_probe_subset(spark, sf_dir):
    asked = query_table(spark, sf_dir)
    allowed = search.subset_codes(encoded(spark, sf_dir), _own_subsets(spark, sf_dir), asked)
    return search.probe(asked, codebook(spark, sf_dir), PROBE, allowed)


def candidates_subset(spark, sf_dir):
    found = search.candidates(ivf_probe_subset(spark, sf_dir), ivf_build(spark, sf_dir))
    return search.restrict(found, _own_subsets(spark, sf_dir))


def search_subset(spark, sf_dir):
    return _results(_search(spark, sf_dir, _own_subsets(spark, sf_dir)))


def search_shared_subset(spark, sf_dir):
    return _results(_search(spark, sf_dir, _thirds(spark, sf_dir)))


def search_metadata_filter(spark, sf_dir):
    subset = metadata.where(meta_create(spark, sf_dir), "lang = ? AND n_chars > ?", ["en", 1000])
    return _results(_search(spark, sf_dir, subset))


# -- changes ---------------------------------------------------------------------------------------------


def outlier_tokens(spark, sf_dir):
    own = codec(spark, sf_dir)
    return mutate.outliers(tokens(spark, sf_dir), own.centroids, own.cluster_threshold).select("doc_id", "pos", F.round("dist", 6).alias("dist"))


def _expanded(spark, sf_dir):
    own = codec(spark, sf_dir)
    late = tokens(spark, sf_dir).filter("doc_id >= 120")
    return mutate.expand(late, own.centroids, own.cluster_threshold, 1, 16, order=order())


def expand_centroids(spark, sf_dir):
    return matrix_rows(spark, _expanded(spark, sf_dir))


def threshold_merge(spark, sf_dir):
    own = codec(spark, sf_dir)
    late = kmeans.assign(tokens(spark, sf_dir).filter("doc_id >= 120"), own.centroids, "dot")
    fresh = codecs.cluster_threshold(codecs.residuals(late, own.centroids))
    n_old, n_new = tokens(spark, sf_dir).agg(F.count(F.when(F.col("doc_id") < 120, 1)), F.count(F.when(F.col("doc_id") >= 120, 1))).first()
    return _values(spark, [mutate.merge_thresholds(own.cluster_threshold, n_old, fresh, n_new)])


def _code_rows(rows):
    return rows.select("doc_id", F.posexplode("codes").alias("pos", "code"))


def _index(spark, sf_dir, label: str, docs, **options) -> MultiVectorIndex:
    """An index on disk with the catalogue's codebook (or, with ``n_centroids``, its own)."""
    index = MultiVectorIndex(spark, Workspace(spark, label).at("index"), ordered=True)
    if "n_centroids" not in options:
        options["codec"] = codec(spark, sf_dir)
    return index.create(docs, **options)


def _stored_codes(index: MultiVectorIndex):
    return _code_rows(index.state().table("encoded"))


def update_append(spark, sf_dir):
    """Documents from 120 on appended to an index in two updates; they wait in its buffer and have the existing codes."""
    docs = documents(spark, sf_dir)
    index = _index(spark, sf_dir, "append", docs.filter("doc_id < 120"), start_from_scratch=0)
    size = docs.count() + 1
    for part in ("doc_id >= 120 and doc_id < 150", "doc_id >= 150"):
        index.update(docs.filter(part), start_from_scratch=0, buffer_size=size)
    return _stored_codes(index)


def update_flush(spark, sf_dir):
    """The buffer of an index is full: waiting documents are encoded anew with centroids for their outliers; others keep their codes."""
    docs = documents(spark, sf_dir)
    index = _index(spark, sf_dir, "flush", docs.filter("doc_id < 120"), start_from_scratch=0)
    waiting = docs.filter("doc_id >= 120").count()
    for part in ("doc_id >= 120 and doc_id < 150", "doc_id >= 150"):
        index.update(docs.filter(part), kmeans_niters=1, max_points_per_centroid=16, start_from_scratch=0, buffer_size=waiting)
    return _stored_codes(index)


def update_rebuild(spark, sf_dir):
    """An index that is small enough to be trained anew on old and appended documents."""
    docs = documents(spark, sf_dir)
    options = {"kmeans_niters": STEPS, "nbits": NBITS, "n_centroids": K, "n_samples_kmeans": 1 << 40, "max_points_per_centroid": 1 << 40, "start_from_scratch": 1 << 40}
    index = _index(spark, sf_dir, "rebuild", docs.filter("doc_id < 120"), **options)
    return _stored_codes(index.update(docs.filter("doc_id >= 120"), **options))


def delete_reindex(spark, sf_dir):
    """An index without every seventh document, renumbered without gaps."""
    docs = documents(spark, sf_dir)
    index = _index(spark, sf_dir, "delete", docs, start_from_scratch=0)
    return _stored_codes(index.delete(docs.filter("doc_id % 7 = 3").select("doc_id")))


def delete_metadata(spark, sf_dir):
    """The metadata of an index after a deletion: lengths of its documents, under their new numbers."""
    docs = documents(spark, sf_dir)
    about = docs.select(F.col("doc_id").alias(metadata.KEY), F.size("vectors").cast("long").alias("length"))
    index = _index(spark, sf_dir, "about", docs, start_from_scratch=0, metadata_rows=about)
    return index.delete(docs.filter("doc_id % 7 = 3").select("doc_id")).get()


def update_compaction(spark, sf_dir):
    """Ten appends, one of them delivered twice: the codes, and of how many folders the table is made."""
    docs = documents(spark, sf_dir)
    index = _index(spark, sf_dir, "compaction", docs.filter("doc_id < 120"), start_from_scratch=0)
    later, size = docs.filter("doc_id >= 120"), docs.count() + 1
    last = docs.agg(F.max("doc_id")).first()[0]
    step = max(1, -(-(last - 119) // 10))
    for k in range(10):
        part = later.filter(F.floor((F.col("doc_id") - 120) / step) == k)
        for _ in range(1 + (k == 4)):
            index.update(part, start_from_scratch=0, buffer_size=size, batch=("rows", k))
    folders = len(index.state().manifest["tables"]["encoded"])
    return _stored_codes(index).withColumn("compact", F.lit(folders <= 8))


def index_roundtrip(spark, sf_dir):
    """An index created, updated and deleted from on disk; its counts."""
    ws, docs = Workspace(spark, "roundtrip"), documents(spark, sf_dir)
    index = MultiVectorIndex(spark, ws.at("index"))
    index.create(docs.filter("doc_id < 120"), kmeans_niters=1, n_centroids=K, start_from_scratch=0)
    index.update(docs.filter("doc_id >= 120"), kmeans_niters=1, start_from_scratch=0, buffer_size=1_000_000)
    index.delete([0, 7, 99_999_999])
    state = index.state()
    return state.table("encoded").agg(F.count("*").alias("num_documents"), F.sum(F.size("codes")).alias("num_embeddings"), F.max("doc_id").alias("last_id"))


def compress_only_guard(spark, sf_dir):
    """An index without inverted file reconstructs but refuses to search."""
    index = MultiVectorIndex(spark, Workspace(spark, "compress").at("index"))
    index.create(documents(spark, sf_dir), kmeans_niters=1, n_centroids=K, compress_only=True, start_from_scratch=0)
    try:
        index.search(query_table(spark, sf_dir))
        refused = False
    except ValueError:
        refused = True
    rows = index.get_embeddings([0, 1, 2])
    return rows.agg(F.count("*").alias("reconstructed")).withColumn("search_refused", F.lit(refused)).withColumn("has_ivf", F.lit(index.state().has("ivf")))


# -- metadata --------------------------------------------------------------------------------------------


def meta_create(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    numbers = mutate.renumber(Workspace(spark, "meta"), rows, rows.filter("false").select("doc_id"))
    numbered = mutate.apply_numbers(rows, numbers).withColumnRenamed("doc_id", metadata.KEY)
    return metadata.create(numbered)


def meta_update(spark, sf_dir):
    """All documents, then all labels appended as rows with two new columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    numbers = mutate.renumber(Workspace(spark, "meta"), labels, labels.filter("false").select("doc_id"))
    more = mutate.apply_numbers(labels, numbers).withColumnRenamed("doc_id", metadata.KEY)
    more = more.select(metadata.KEY, F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return metadata.update(meta_create(spark, sf_dir), more)


def meta_delete(spark, sf_dir):
    table = meta_create(spark, sf_dir)
    return metadata.delete(table, table.filter(f"{metadata.KEY} % 7 = 0").select(F.col(metadata.KEY).alias("doc_id")))


def meta_get_condition(spark, sf_dir):
    return metadata.get(meta_create(spark, sf_dir), "lang = ? AND n_chars >= ? AND \"source\" LIKE 'SRC1%'", ["en", 2000])


def meta_get_subset(spark, sf_dir):
    return metadata.get(meta_create(spark, sf_dir), subset=[5, 2, 5, 99_999_999, 7])


def meta_where(spark, sf_dir):
    return metadata.where(meta_create(spark, sf_dir), "source like ? OR n_chars < ?", ["src_", 100])


def meta_divide(spark, sf_dir):
    """Whole numbers divide to whole numbers, and division by zero meets no condition."""
    return metadata.where(meta_create(spark, sf_dir), "n_chars / (n_chars % ?) / 2 >= 100 AND 5 / 2 = 2 OR 3.0 / n_chars > 0.1", [7])


# -- evaluation ------------------------------------------------------------------------------------------


def _judged(spark, sf_dir):
    """Ten best of the index search without the query itself; relevant: the same label at the first token."""
    found = _search(spark, sf_dir, params=search.Params(TOP_K + 1, N_FULL, PROBE))
    ranked = evaluation.drop_self_matches(found.select("query_id", "rank", "doc_id"))
    first = token_table(spark, sf_dir).filter("pos = 0").select("doc_id", "label")
    asked = first.filter(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"), "label")
    qrels = asked.join(first, "label").filter("doc_id != query_id").select("query_id", "doc_id", F.lit(1).alias("rel"))
    return ranked, qrels


def _metric(spark, sf_dir, column, k=TOP_K):
    ranked, qrels = _judged(spark, sf_dir)
    rows = evaluation.per_query(ranked, qrels, k).select("query_id", F.col(column).alias("value"))
    return rows if column == "hits" else rounded(rows, "value")


def eval_ndcg(spark, sf_dir):
    return _metric(spark, sf_dir, "ndcg")


def eval_hits(spark, sf_dir):
    return _metric(spark, sf_dir, "hits", 5)


def eval_map(spark, sf_dir):
    return _metric(spark, sf_dir, "ap")


def eval_recall(spark, sf_dir):
    return _metric(spark, sf_dir, "recall")


def eval_duplicates(spark, sf_dir):
    """Queries of the same vectors have the results of the first of them."""
    found = search.bruteforce_topk(documents(spark, sf_dir), _queries(spark, sf_dir), 3)
    asked = query_table(spark, sf_dir).withColumnRenamed("vectors", "query")
    return rounded(evaluation.add_duplicates(found, asked)).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


QUERIES = [
    scan_token_rows, query_explode, doc_lengths, doc_offsets, index_stats, index_manifest, maxsim_bruteforce, maxsim_relational, search_topk_exact, token_scores,
    num_partitions, kmeans_sample_size, kmeans_init, kmeans_assign, kmeans_assign_relational, kmeans_update, kmeans_centroids, l2_normalize,
    assign_codes, residuals, heldout_tokens, bucket_cutoffs, bucket_weights, cluster_threshold, avg_residual, bucketize, pack_residuals,
    reconstruct, get_embeddings, ivf_build, ivf_lengths, ivf_merge, centroid_scores, ivf_probe, candidates, approx_scores, prune_stage1,
    prune_stage2, exact_rerank, search_topk, ivf_probe_subset, candidates_subset, search_subset, search_shared_subset, search_metadata_filter,
    outlier_tokens, expand_centroids, threshold_merge, update_append, update_flush, update_rebuild, delete_reindex, delete_metadata, update_compaction, index_roundtrip,
    compress_only_guard, meta_create, meta_update, meta_delete, meta_get_condition, meta_get_subset, meta_where, meta_divide, eval_ndcg, eval_hits,
    eval_map, eval_recall, eval_duplicates,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
