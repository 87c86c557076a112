"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file.

A text of more than ``long_chars`` characters is cut where every tokenisation cuts: between a letter
and a single space that a letter follows. No alternative of the split pattern matches across that
point, none looks behind, and the only look-ahead is about white space that isn't there, so the parts'
ids one after another are the text's ids. Where a long text has no such place (one word or one run of
white space of many megabytes), it is split into the pattern's matches here and each is merged alone.

Decoding joins the bytes of the ids. Edge cases: a null text is the empty text and has no ids; bytes
that aren't UTF-8 count as the replacement character; repeated rows and rows with equal or null ids are
encoded each by itself; an empty table gives an empty result; only the id and text columns are read, so
extra columns never clash.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import limit_batches, slices, tidy
from .common import text_or_empty

LONG_CHARS = 1 << 16


def default_ranks() -> tuple[str, str]:
    """Path and split pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Codec:
    """Encoder and decoder for a rank file and a split pattern."""

    def __init__(self, path: str, pattern: str, long_chars: int = LONG_CHARS):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.safe = regex.compile(r"\p{L} (?=\p{L})")
        self.pattern = regex.compile(pattern)
        self.long_chars = long_chars

    def parts(self, text: str) -> list[str]:
        """The text in parts that are tokenised alike apart."""
        found, start = [], 0
        while len(text) - start > self.long_chars:
            cut = self.safe.search(text, start + self.long_chars - 1)
            if cut is None:
                break
            found.append(text[start : cut.start() + 1])
            start = cut.start() + 1
        found.append(text[start:])
        return found

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.long_chars:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in self.parts(text):
            if len(part) <= 2 * self.long_chars:
                ids += self.encoding.encode_ordinary(part)
            else:
                for match in self.pattern.finditer(part):
                    ids += self.encoding._encode_single_piece(match.group())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, long_chars: int = LONG_CHARS) -> Codec:
    """One codec a worker process, not one a batch."""
    return Codec(path, pattern, long_chars)


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS) -> DataFrame:
    """One row a document: doc_id, ids (array of int), decoded (the bytes that the ids stand for)."""
    if ranks is None or pattern is None:
        path, split = default_ranks()
        ranks, pattern = ranks or path, pattern or split

    limit_batches(docs.sparkSession)

    def work(batches):
        own = codec(ranks, pattern, long_chars)
        for batch in slices(batches):
            ids = [own.encode(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(work), f"doc_id {kind}, ids array<int>, decoded binary")


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by spaces), decoded_sha256."""
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
