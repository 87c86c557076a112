"""Arrow batches in and out of Python, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Rows of an Arrow batch; with texts or sets of some KB each, a batch has some MB on either side of the pipe.
BATCH_ROWS = 1_000
#: Bytes of text that are worked on at once in a Python task.
SLICE_BYTES = 1 << 18


def tidy(work):
    """``work`` that gives freed memory back to the system when a task ends; worker processes live on and are many."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass

    return run


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges with about ``limit`` bytes in the binary ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column(batch.schema.get_field_index(column))
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] if pa.types.is_binary(data.type) else np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + limit, side="right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def raw(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array without nulls, one after another, and where each row starts and the last ends."""
    kind = np.int32 if pa.types.is_binary(data.type) else np.int64
    ends = np.frombuffer(data.buffers()[1], kind)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    body = data.buffers()[2]
    flat = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def limit_batches(spark, rows: int = BATCH_ROWS) -> None:
    """Lower this session's rows per Arrow batch to ``rows``; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
