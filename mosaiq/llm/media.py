"""Media columns stored as content-defined chunks.

A payload is a text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, taken as 8-bit
samples. A gear hash rolls over it (32 bits, so it depends on the last 32 bytes) and cuts where its low
bits are zero, at least ``least`` and at most ``most`` bytes after the last cut. Chunks are named by a
160-bit digest.

A media's manifest lists the digests and lengths of its chunks in order; its stored form is the manifest
followed by its samples. The store keeps every chunk once:

1. One pass over all texts yields the manifests. Media with the same manifest are one media.
2. Digests are grouped and joined: each chunk belongs to one media (its owner), the others borrow it.
3. A second pass writes one row a media: manifest and owned chunks.
4. Rows are read back. Media that borrow nothing are put together where they are; for the others the
   lent chunks are joined by digest (salted if many borrow it) and grouped by media. Each chunk is
   checked against its digest, the whole against its length, and features are computed from the samples.

Only texts that share chunks move. Which rows own, borrow or skip is broadcast if that table is small
(``BROADCAST_BYTES``). Otherwise a bit table of fixed size tells which texts may be among them, and only these
are joined with it.

Edge cases: a null text is empty, and an empty one is 576 bytes 255; repeated rows, rows with null ids and
rows with equal texts have one media, kept by the row with the smallest id (null last); very long texts are
cut whole and stored as one row; an empty table gives an empty result. Only the id and text columns are
read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.workspace import Workspace

from .arrow import limit_batches, raw, slices, tidy
from .common import join_groups, parted_by_keys, text_or_empty
from .hashing import constants

UNIT = 576
LEAST, BITS, MOST = 256, 9, 4096
BROADCAST_BYTES = 32 << 20
#: Media that may be sent to all tasks with their digests and features (about 400 bytes each).
BROADCAST_MEDIA = 60_000
#: Borrowers of a chunk for each copy of it in the join.
SALT = 1_000
MAGIC = b"CDC1"
SLICE = 1 << 18


def payloads(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The padded payloads of all rows one after another, and their ends with a leading 0."""
    sizes = np.diff(ends)
    padded = np.maximum(-(-sizes // UNIT), 1) * UNIT
    out_ends = np.concatenate([[0], np.cumsum(padded)])
    out = np.full(out_ends[-1], 255, np.uint8)
    out[np.arange(len(flat)) + np.repeat(out_ends[:-1] - ends[:-1], sizes)] = flat
    return out, out_ends


def gear(flat: np.ndarray) -> np.ndarray:
    """At each place the sum of the last 32 bytes' gear values, shifted by their distance."""
    h = (constants(256, 31) >> np.uint64(32)).astype(np.uint32)[flat]
    width = 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(flat: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each row the ends of its chunks."""
    marks = (np.flatnonzero((gear(flat) & np.uint32((1 << BITS) - 1)) == 0) + 1).tolist()
    found = []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        own = []
        while start < end:
            k = bisect_left(marks, start + LEAST)
            stop = min(marks[k] if k < len(marks) else end, start + MOST, end)
            own.append(stop)
            start = stop
        found.append(own)
    return found


def digest(chunk) -> bytes:
    return hashlib.blake2b(chunk, digest_size=20).digest()


def manifest(n_bytes: int, names: list[bytes], sizes: list[int]) -> bytes:
    head = MAGIC + struct.pack("<QQI", n_bytes, sum(sizes), len(names))
    return head + b"".join(name + struct.pack("<I", size) for name, size in zip(names, sizes))


def chunked(batch: pa.RecordBatch):
    """Of each row: bytes in its text, media name, digests, chunks."""
    flat, ends = raw(batch.column(batch.schema.get_field_index("text")))
    body, places = payloads(flat, ends)
    view = memoryview(body.tobytes())
    for n, start, own in zip(np.diff(ends).tolist(), places[:-1].tolist(), cuts(body, places)):
        chunks = [view[a:b] for a, b in zip([start, *own[:-1]], own)]
        names = [digest(c) for c in chunks]
        sizes = [len(c) for c in chunks]
        yield n, hashlib.sha256(manifest(n, names, sizes)).digest(), names, chunks


def features(samples: np.ndarray) -> str:
    """Mean, deviation, least and greatest sample, entropy in bits and mean absolute step."""
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256)
    total = len(samples)
    mean = float((counts * values).sum()) / total
    square = float((counts * values * values).sum()) / total
    share = counts[counts > 0] / total
    step = np.abs(np.diff(samples.astype(np.int16))).sum() / max(total - 1, 1)
    seen = np.flatnonzero(counts)
    return f"mean={mean:.4f};std={max(square - mean * mean, 0) ** 0.5:.4f};min={seen[0]};max={seen[-1]};entropy={-(share * np.log2(share)).sum():.4f};step={step:.4f}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, media, n_bytes) and the stored media (media, n_bytes, names, sizes, owned, borrowed)."""
    limit_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "media")
    text = text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def describe(batches):
        for batch in slices(batches, "text", SLICE):
            n, media, names = zip(*((n, m, d) for n, m, d, _ in chunked(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(media, pa.binary()), pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.binary()))],
                ["doc_id", "tag", "media", "n_bytes", "names"],
            )

    seen = ws.save(rows.mapInArrow(tidy(describe), f"doc_id {kind}, tag long, media binary, n_bytes long, names array<binary>"), "manifests")
    who = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("tag").alias("tag"))
    media = seen.groupBy("media").agg(F.min(who).alias("keeper"), F.first("names").alias("names"))
    media = ws.save(media.withColumn("id", F.monotonically_increasing_id()), "distinct")
    uses = media.select("id", F.explode(F.array_distinct("names")).alias("name"))
    chunks = ws.save(uses.groupBy("name").agg(F.min("id").alias("owner"), F.count("*").alias("n")).filter("n > 1"), "shared")
    parts = uses.join(chunks, "name").groupBy("id").agg(
        F.collect_list(F.when(F.col("id") != F.col("owner"), F.struct("name", "n"))).alias("borrowed"),
        F.collect_list(F.when(F.col("id") == F.col("owner"), F.struct("name", "n"))).alias("lent"),
    )
    # Rows of the second pass that don't just store all they have.
    owners = media.select("id", "media", "keeper").join(parts, "id", "left").drop("id")
    odd = (
        seen.select("doc_id", "tag", "media").join(owners, "media")
        .withColumn("skip", ~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("tag") == F.col("keeper.tag"))))
        .filter("skip or size(borrowed) > 0 or size(lent) > 0")
        .select("doc_id", "tag", "skip", F.when(~F.col("skip"), F.col("borrowed")).alias("borrowed"), F.when(~F.col("skip"), F.col("lent")).alias("lent"))
        .dropDuplicates(["doc_id", "tag"])
    )
    odd = ws.save(odd.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "skip", "borrowed", "lent"), "roles")
    # Hashed rows: keys and pointers, and 56 bytes for each element of an array.
    heft = F.lit(160) + F.coalesce(F.octet_length(F.col("_id").cast("string")), F.lit(0)) + 56 * (F.greatest(F.size("borrowed"), F.lit(0)) + F.greatest(F.size("lent"), F.lit(0)))
    weight = odd.agg(F.coalesce(F.sum(heft), F.lit(0))).first()[0]
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    columns = ["text", "borrowed", "lent"]
    if weight <= BROADCAST_BYTES:
        todo = rows.join(F.broadcast(odd), same, "left").filter("skip is null or not skip").select(*columns)
    else:
        alone, others = parted_by_keys(rows, ["doc_id", "tag"], odd, ["_id", "_tag"])
        todo = others.join(odd, same, "left").filter("skip is null or not skip").select(*columns)
        todo = todo.unionByName(alone.select("text", *[F.lit(None).cast(odd.schema[c].dataType).alias(c) for c in columns[1:]]))

    def write(batches):
        for batch in slices(batches, "text", SLICE):
            out = {k: [] for k in ("media", "n", "names", "sizes", "owned", "borrowed")}
            borrowed, lent = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for (n, name, names, chunks), theirs, ours in zip(chunked(batch), borrowed, lent):
                foreign = {x["name"]: x["n"] for x in theirs or ()}
                many = {x["name"]: x["n"] for x in ours or ()}
                own = {d: c for d, c in zip(names, chunks) if d not in foreign}
                out["media"].append(name)
                out["n"].append(n)
                out["names"].append(names)
                out["sizes"].append([len(c) for c in chunks])
                out["owned"].append([{"name": d, "body": bytes(c), "n": many.get(d, 0)} for d, c in own.items()])
                out["borrowed"].append([{"name": d, "n": k} for d, k in foreign.items()])
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.struct([("name", pa.binary()), ("body", pa.binary()), ("n", pa.int64())])), pa.list_(pa.struct([("name", pa.binary()), ("n", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], ["media", "n_bytes", "names", "sizes", "owned", "borrowed"])

    schema = "media binary, n_bytes long, names array<binary>, sizes array<int>, owned array<struct<name:binary,body:binary,n:bigint>>, borrowed array<struct<name:binary,n:bigint>>"
    written = todo.mapInArrow(tidy(write), schema)
    if not seen.groupBy("doc_id", "tag").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        written = written.dropDuplicates(["media"])  # a row that occurs twice would store its media twice
    stored = ws.save(written, "store")
    ws.drop("distinct", "shared", "roles")
    return seen.select("doc_id", "media", "n_bytes"), stored


def _parted(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored media that borrow nothing, and the others with the chunks that they borrow (``got``)."""
    salts = F.ceil(F.col("c.n") / SALT).cast("int")
    lent = stored.select(F.explode("owned").alias("c")).filter("c.n > 0").select("c.name", "c.body", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    wants = stored.filter("size(borrowed) > 0").select("media", F.explode("borrowed").alias("c")).select(
        "media", "c.name", F.pmod(F.xxhash64("media"), salts).cast("int").alias("salt")
    )
    got = wants.join(lent, ["name", "salt"]).groupBy("media").agg(F.collect_list(F.struct("name", "body")).alias("got"))
    columns = ["media", "n_bytes", "names", "sizes", F.transform("owned", lambda c: F.struct(c["name"].alias("name"), c["body"].alias("body"))).alias("owned")]
    none = F.lit(None).cast("array<struct<name:binary,body:binary>>")
    whole = stored.filter("size(borrowed) = 0").select(*columns, none.alias("got"))
    return whole, stored.filter("size(borrowed) > 0").select(*columns).join(got, "media").select("media", "n_bytes", "names", "sizes", "owned", "got")


def rebuilt(batches, rows: int = 64):
    """Lists of (media, manifest, samples), a few rows at a time: chunks put together and verified."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            out = []
            for row in batch.slice(k, rows).to_pylist():
                have = {c["name"]: c["body"] for c in row["owned"] + (row["got"] or [])}
                for name, body in have.items():
                    if digest(body) != name:
                        raise ValueError("a stored chunk differs from its digest")
                body = b"".join(map(have.__getitem__, row["names"]))
                head = manifest(row["n_bytes"], row["names"], row["sizes"])
                if len(body) != sum(row["sizes"]) or hashlib.sha256(head).digest() != row["media"]:
                    raise ValueError("a stored media differs from its manifest")
                out.append((row["media"], head, body))
            yield out


def _run(stored: DataFrame, work, schema: str) -> DataFrame:
    whole, parted = _parted(stored)
    return whole.mapInArrow(tidy(work), schema).unionByName(parted.mapInArrow(tidy(work), schema))


def described(stored: DataFrame) -> DataFrame:
    """(media, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of samples read back."""

    def describe(media: bytes, head: bytes, body: bytes) -> tuple:
        whole = hashlib.sha256(head)
        whole.update(body)
        return media, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(head) + len(body), whole.hexdigest(), features(np.frombuffer(body, np.uint8))

    def work(batches):
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for rows in rebuilt(batches):
            columns = zip(*(describe(*row) for row in rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return _run(stored, work, "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes and the description of its media as read back from the store."""
    seen, stored = store(docs, id_col, text_col)
    sizes = seen.groupBy("media").agg(F.count("*").alias("n"))
    told = described(stored).join(sizes, "media")
    return join_groups(seen, Workspace(docs.sparkSession, "media-told").save(told, "told"), ["media"], "n", BROADCAST_MEDIA).drop("media", "n")
