"""The residual codec: one scalar quantiser for all dimensions, with exact quantiles as its codebook."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import dense

from .kmeans import assign

HELD_OUT_SHARE = 0.05
HELD_OUT_MOST = 50_000


@dataclass
class Codec:
    nbits: int
    centroids: np.ndarray
    cutoffs: np.ndarray
    weights: np.ndarray
    avg_residual: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cluster_threshold: float = 0.0

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def check_layout(nbits: int, dim: int) -> None:
    if nbits not in (1, 2, 4, 8):
        raise ValueError(f"nbits must be 1, 2, 4 or 8, not {nbits}")
    if dim % 8:
        raise ValueError(f"the dimension must be a multiple of 8, not {dim}")


def held_out_size(tokens: int) -> int:
    """Tokens that the codec is trained on: a twentieth, at most 50,000, at least one."""
    return max(1, round(min(HELD_OUT_SHARE * tokens, HELD_OUT_MOST)))


def held_out(tokens: DataFrame, n: int | None = None) -> DataFrame:
    """The last ``n`` tokens by (doc_id, pos)."""
    n = held_out_size(tokens.count()) if n is None else n
    return tokens.orderBy(F.desc("doc_id"), F.desc("pos")).limit(n)


def residuals(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` (.., v, code) with ``r``, the vector less its centroid."""
    shared = assigned.sparkSession.sparkContext.broadcast(centroids)

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x = dense.vectors(batch.column(batch.schema.names.index("v")))
                r = x - shared.value[np.asarray(batch.column(batch.schema.names.index("code")))]
                yield pa.RecordBatch.from_arrays([*batch.columns, dense.matrices(r, pa.float64())], [*batch.schema.names, "r"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in assigned.schema)
    return assigned.mapInArrow(work, schema + ", r array<double>")


def quantiles(residual_rows: DataFrame, nbits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cutoffs at i / 2^nbits and weights at (i + 1/2) / 2^nbits of all residual values, interpolated exactly."""
    n = 1 << nbits
    at = [i / n for i in range(1, n)] + [(i + 0.5) / n for i in range(n)]
    values = residual_rows.select(F.explode("r").alias("x"))
    found = values.agg(F.percentile("x", F.array(*map(F.lit, at)))).first()[0]
    return np.array(found[: n - 1]), np.array(found[n - 1 :])


def cluster_threshold(residual_rows: DataFrame) -> float:
    """The 0.75 quantile of residual norms."""
    norm = F.sqrt(F.aggregate(F.transform("r", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return residual_rows.select(norm.alias("n")).agg(F.percentile("n", F.lit(0.75))).first()[0]


def average_residual(residual_rows: DataFrame) -> DataFrame:
    """(dim, avg): the mean absolute residual of each dimension; a diagnostic."""
    return residual_rows.select(F.posexplode("r").alias("dim", "x")).groupBy("dim").agg(F.avg(F.abs("x")).alias("avg"))


def train(sample: DataFrame, centroids: np.ndarray, nbits: int = 4) -> Codec:
    """A codec from token rows (doc_id, pos, v)."""
    check_layout(nbits, centroids.shape[1])
    rows = residuals(assign(held_out(sample), centroids, "dot"), centroids).select("r").persist()
    try:
        cutoffs, weights = quantiles(rows, nbits)
        mean = np.array([r["avg"] for r in average_residual(rows).orderBy("dim").collect()])
        return Codec(nbits, centroids, cutoffs, weights, mean, float(cluster_threshold(rows)))
    finally:
        rows.unpersist()


def encode(documents: DataFrame, codec: Codec) -> DataFrame:
    """Nested documents as (doc_id, codes, residuals): a centroid and packed buckets a token. No shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(codec)

    def work(batches):
        own = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x, ends = dense.ragged(part.column(1))
                if not len(x):
                    codes, packed = np.zeros(0, np.int32), np.zeros((0, 0), np.uint8)
                else:
                    codes = dense.argmax_dot(x, own.centroids)
                    packed = dense.pack(dense.bucketize(x - own.centroids[codes], own.cutoffs), own.nbits)
                width = own.dim * own.nbits // 8
                body = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(packed.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), dense.lists(codes, ends, pa.int32()), body], ["doc_id", "codes", "residuals"])

    return documents.select("doc_id", "vectors").mapInArrow(work, "doc_id long, codes array<int>, residuals binary")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """``encoded`` with ``vectors``: the reconstructed unit vectors."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)
    keep = [c for c in encoded.columns if c not in ("codes", "residuals")]

    def work(batches):
        own = shared.value
        for batch in batches:
            names = batch.schema.names
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                codes, ends = codes_of(part.column(names.index("codes")))
                packed = packed_of(part.column(names.index("residuals")))
                x = dense.reconstruct(codes, packed, own.centroids, own.weights, own.nbits)
                inner = dense.matrices(x, pa.float32()) if len(x) else pa.array([], pa.list_(pa.float32()))
                nested = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays([*[part.column(names.index(c)) for c in keep], nested], [*keep, "vectors"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in keep)
    return encoded.mapInArrow(work, schema + ", vectors array<array<float>>")


def codes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.asarray(column.flatten(), np.int64), np.concatenate([[0], np.cumsum(sizes)])


def packed_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def bucket_rows(encoded: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, pos, code, buckets): what is packed, unpacked again."""
    shared = encoded.sparkSession.sparkContext.broadcast((codec.nbits, codec.dim))

    def work(batches):
        nbits, dim = shared.value
        for batch in batches:
            codes, ends = codes_of(batch.column(1))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            pos = np.arange(len(codes)) - ends[:-1][owner]
            buckets = dense.unpack(packed_of(batch.column(2)), nbits, dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(pos, pa.int32()), pa.array(codes, pa.int32()), dense.matrices(buckets.astype(np.int32), pa.int32())],
                ["doc_id", "pos", "code", "buckets"],
            )

    return encoded.select("doc_id", "codes", "residuals").mapInArrow(work, "doc_id long, pos int, code int, buckets array<int>")
