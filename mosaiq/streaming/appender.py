"""A Structured Streaming sink that appends micro-batches of token rows to an index.

Each micro-batch is one ``update``: small batches wait in the buffer, and outliers get centroids when it
is full. A batch's number is committed with its documents, in the index's manifest under the stream's
name, so a batch that a restarted query delivers again, to this or another process, is appended once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mosaiq.plans.index import MultiVectorIndex
from mosaiq.sources.token_rows import as_documents


def append_batches(index: MultiVectorIndex, stream: str = "stream", **options):
    """A function for ``foreachBatch``; streams that write to one index need names of their own."""

    def append(batch: DataFrame, number: int) -> None:
        documents = as_documents(batch.sparkSession, batch)
        if not documents.isEmpty():
            index.update(documents, batch=(stream, number), **options)

    return append


def start(stream: DataFrame, index: MultiVectorIndex, checkpoint: str, **options) -> StreamingQuery:
    """Append everything that a stream of (doc_id, pos, v) or (doc_id, vectors) has now, then stop.

    The checkpoint names the stream: its batches are numbered from 0 on.
    """
    writer = stream.writeStream.foreachBatch(append_batches(index, checkpoint, **options)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
