"""Arrow/numpy kernels: ragged documents in, scores, codes and packed residuals out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .vectors import EPSILON

#: Elements of a block of products that is held at once (8 bytes each).
BLOCK = 1 << 22


def vectors(column: pa.Array) -> np.ndarray:
    """A list<float> column as a matrix of doubles; all rows have the same length."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list<list<float>> column as one matrix of all vectors and the rows' ends with a leading 0."""
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return vectors(column.flatten()), np.concatenate([[0], np.cumsum(sizes)])


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def matrices(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    return lists(values.ravel(), np.arange(len(values) + 1) * values.shape[1], kind)


def argmax_dot(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the centroid with the greatest dot product, the first of equals."""
    out = np.zeros(len(x), np.int32)
    step = max(1, BLOCK // max(len(centroids), 1))
    for k in range(0, len(x), step):
        out[k : k + step] = (x[k : k + step] @ centroids.T).argmax(1)
    return out


def argmin_distance(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid (the first of equals) and the squared distance."""
    out, far = np.zeros(len(x), np.int32), np.zeros(len(x))
    norms = (centroids * centroids).sum(1)
    step = max(1, BLOCK // max(len(centroids), 1))
    for k in range(0, len(x), step):
        part = x[k : k + step]
        d = (part * part).sum(1)[:, None] + norms - 2 * (part @ centroids.T)
        out[k : k + step] = d.argmin(1)
        far[k : k + step] = d.min(1)
    return out, np.maximum(far, 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), EPSILON)


def bucketize(values: np.ndarray, cutoffs: np.ndarray) -> np.ndarray:
    """The number of cutoffs below each value."""
    return np.searchsorted(cutoffs, values, side="left").astype(np.uint8)


def pack(buckets: np.ndarray, nbits: int) -> np.ndarray:
    """Rows of bucket numbers as bytes: each number's lowest bit first, eight bits a byte, highest first."""
    bits = (buckets[..., None] >> np.arange(nbits, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(buckets), buckets.shape[1] * nbits), axis=1)


def unpack(packed: np.ndarray, nbits: int, dim: int) -> np.ndarray:
    bits = np.unpackbits(packed.reshape(-1, dim * nbits // 8), axis=1).reshape(-1, dim, nbits)
    return (bits << np.arange(nbits, dtype=np.uint8)).sum(2).astype(np.uint8)


def reconstruct(codes: np.ndarray, packed: np.ndarray, centroids: np.ndarray, weights: np.ndarray, nbits: int) -> np.ndarray:
    """Unit vectors of centroid plus each dimension's bucket weight."""
    return unit(centroids[codes] + weights[unpack(packed, nbits, centroids.shape[1])])


def maxsim(similarities: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """From (tokens of all documents) x (query tokens): for each document the sum of its columns' maxima."""
    return np.maximum.reduceat(similarities, starts, axis=0).sum(1)
