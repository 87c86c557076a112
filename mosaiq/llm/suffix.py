"""Removal of repeated substrings: every byte covered by a string of ``length`` bytes that also starts earlier.

A suffix array of a large corpus holds one suffix a byte. Here only suffixes that can matter are
sorted, in blocks:

1. Every window of ``length`` bytes has a *minimizer*: of its 32-byte substrings the one with the least
   hash, the first of equals. Equal windows have it at the same place. Neighbouring windows with the
   same minimizer form a block, whose bytes are the left context and the suffix from the minimizer on,
   about 35 suffix starts each.
2. Minimizers are counted over the whole table. A minimizer that occurs once can't be in a repeated
   window; blocks of such are not moved. A bit table of bounded size tells them apart in the second
   pass; its errors only move more.
3. Splitters sampled from the repeated minimizers range-partition blocks by the minimizer's leading
   bytes (its first eight, then its hash), so that every partition has about ``part_rows`` blocks. A
   minimizer with more than that many blocks gets several partitions.
4. Each partition sorts its blocks by multikey quicksort over words (leading bytes, minimizer, block,
   document). Blocks equal to an earlier one are repeated as a whole. The first of each kind are
   compared window by window with the others of their minimizer. All equalities are confirmed on bytes.
5. Where a minimizer has several partitions, windows that are first in their own partition are compared
   across the boundaries, on their bytes: one row a window and partition at most.

Edge cases: a null text is empty; texts shorter than ``length`` keep all; very long texts are cut into
overlapping pieces of 1 MB; ids may be of any type that can be ordered, null ids come last, and rows with
the same id are ordered by their text; of repeated rows (same id and text) one counts as the original. An
empty table gives an empty result. Only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.plans.workspace import Workspace

from .arrow import limit_batches, raw, slices, tidy
from .common import numbered
from .hashing import byte_table, mix, prefixes, ranges

LENGTH = 100
SEED_BYTES = 32
#: Bytes that are searched at once; positions in them take 20 bits.
PIECE = 1 << 20
PART_ROWS = 20_000
#: Bits in the table of repeated minimizers: 16 for each, within these bounds (8 KB to 64 MB).
MIN_BITS, MAX_BITS = 16, 29
SPLIT_SAMPLE = 50_000


def _minimizer_hashes(flat: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 32 bytes along the last axis."""
    h = byte_table(3)[flat]
    factor, width = 0x9E3779B97F4A7C15, 1
    while width < SEED_BYTES:
        h = h[..., :-width] * np.uint64(factor) + h[..., width:]
        factor = (factor * factor + 2) & ((1 << 64) - 1)
        width *= 2
    return mix(h)


def blocks(flat: np.ndarray, ends: np.ndarray, length: int):
    """For pieces of the rows: (bytes, piece's place, minimizer hashes, minimizers' and blocks' first and last windows' places)."""
    width = length - SEED_BYTES + 1
    for start in range(0, max(len(flat) - length + 1, 0), PIECE - length + 1):
        piece = flat[start : start + PIECE]
        if len(piece) < length:
            return
        with np.errstate(over="ignore"):
            hashes = _minimizer_hashes(piece)
        key = (hashes & ~np.uint64(PIECE - 1)) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        window = np.arange(len(key)) + start
        row_end = ends[np.searchsorted(ends, window, side="right")]
        window = np.flatnonzero(window + length <= row_end)
        if not len(window):
            continue
        place = (key[window] & np.uint64(PIECE - 1)).astype(np.int64)
        new = np.ones(len(window), bool)
        new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1
        yield piece, start, hashes, place[first], window[first], window[last]


def _leading(piece: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first eight bytes at each place, as a signed number in the order of the bytes."""
    lead = piece[places[:, None] + np.arange(8)].astype(np.uint8)
    return (lead.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte ranges one after another."""
    out = np.cumsum(sizes) - sizes
    return flat[np.arange(int(sizes.sum())) + np.repeat(starts - out, sizes)]


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their words: quicksort by one word, then only runs of equals by the next."""
    order = np.argsort(columns[0], kind="quicksort")
    value = columns[0][order]
    run = np.zeros(len(order), np.int64)
    run[1:] = np.cumsum(value[1:] != value[:-1])
    for column in columns[1:]:
        same = np.zeros(len(run), bool)
        same[1:] = run[1:] == run[:-1]
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        rows = order[tied]
        inner = np.lexsort((column[rows], run[tied]))
        order[tied] = rows[inner]
        value = column[order]
        differs = np.zeros(len(run), bool)
        differs[1:] = (run[1:] != run[:-1]) | ((value[1:] != value[:-1]) & same[1:])
        run = np.cumsum(differs)
    return order


class Partition:
    """The blocks of one partition and what is repeated in them."""

    def __init__(self, table: pa.Table, length: int):
        self.length = length
        number = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        self.doc, self.low, self.at = (number(n) for n in ("doc", "low", "at"))
        self.split = bool(number("split")[0])
        body = table.column("body").combine_chunks()
        body = body if isinstance(body, pa.Array) else pa.concat_arrays(body.chunks)
        self.flat, self.ends = raw(body)
        self.size = np.diff(self.ends)
        places = self.ends[:-1] + self.at  # of the minimizers, which needn't travel beside their bytes
        self.lead = _leading(self.flat, places)
        with np.errstate(over="ignore"):
            self.seed = _minimizer_hashes(self.flat[places[:, None] + np.arange(SEED_BYTES)])[:, 0].view(np.int64)

    def hashed(self, rows: np.ndarray, each):
        """``each(prefix hashes, offsets into them, rows)`` for groups of rows with about 1 MB of bytes."""
        done = 0
        total = np.cumsum(self.size[rows])
        while done < len(rows):
            stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 20))))
            part = rows[done:stop]
            flat = gather(self.flat, self.ends[part], self.size[part])
            with np.errstate(over="ignore"):
                each(prefixes(flat, byte_table(5)), np.cumsum(self.size[part]) - self.size[part], part, slice(done, stop))
            done = stop

    def equal(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the byte ranges of these sizes from places ``a`` and ``b`` on agree."""
        out = np.ones(len(a), bool)
        step = max(1, (4 << 20) // max(int(sizes.max(initial=1)), 1))
        for k in range(0, len(a), step):
            size = sizes[k : k + step]
            same = gather(self.flat, a[k : k + step], size) == gather(self.flat, b[k : k + step], size)
            out[k : k + step] = np.logical_and.reduceat(same, np.cumsum(size) - size) if len(size) else True
        return out

    def solve(self):
        """Repeated windows as (rows, first, last) and, in a split minimizer, first windows as (rows, place, a, bytes)."""
        n = len(self.seed)
        mark = np.zeros(n, np.uint64)

        def whole(prefix, offset, rows, _):
            mark[rows] = mix(ranges(prefix, offset, offset + self.size[rows]) + self.at[rows].astype(np.uint64))

        self.hashed(np.arange(n), whole)
        order = multikey_order([self.lead, self.seed, mark, self.doc, self.low])
        lead, seed, mark = self.lead[order], self.seed[order], mark[order]
        new_seed = np.ones(n, bool)
        new_seed[1:] = (lead[1:] != lead[:-1]) | (seed[1:] != seed[:-1])
        new_mark = new_seed.copy()
        new_mark[1:] |= mark[1:] != mark[:-1]
        original = order[np.maximum.accumulate(np.where(new_mark, np.arange(n), 0))]
        later = np.flatnonzero(~new_mark)
        a, b = order[later], original[later]
        true = (self.size[a] == self.size[b]) & (self.at[a] == self.at[b])
        true[true] = self.equal(self.ends[a[true]], self.ends[b[true]], self.size[a[true]])
        itself = (self.doc[a] == self.doc[b]) & (self.low[a] == self.low[b])
        copies = a[true & ~itself]
        yield "repeat", copies, self.low[copies], self.low[copies] + self.size[copies] - self.length
        leader = new_mark.copy()
        leader[later[~true]] = True
        group = np.cumsum(new_seed) - 1
        several = np.bincount(group[leader])[group] > 1
        chosen = np.flatnonzero(leader & (several | self.split))
        if not len(chosen):
            return
        rows, group = order[chosen], group[chosen]
        by_place = np.lexsort((self.low[rows], self.doc[rows]))
        rows, group = rows[by_place], group[by_place]
        count = self.size[rows] - self.length + 1
        owner = np.repeat(np.arange(len(rows)), count)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        away = self.at[rows][owner] - shift  # of the minimizer from the window's start
        word = np.zeros(len(owner), np.uint64)
        first_window = np.cumsum(count) - count

        def windows(prefix, offset, _, span):
            k = slice(first_window[span.start], first_window[span.stop - 1] + count[span.stop - 1])
            at = np.repeat(offset, count[span]) + shift[k]
            word[k] = ranges(prefix, at, at + self.length)

        self.hashed(rows, windows)
        with np.errstate(over="ignore"):
            key = mix(word + mix(group[owner].astype(np.uint64) * np.uint64(1024) + away.astype(np.uint64)))
        sort = np.argsort(key, kind="stable")
        value = key[sort]
        new = np.ones(len(sort), bool)
        new[1:] = value[1:] != value[:-1]
        source = sort[np.maximum.accumulate(np.where(new, np.arange(len(sort)), 0))]
        place = self.ends[rows][owner] + shift
        again = np.flatnonzero(~new)
        x, y = sort[again], source[again]
        true = (group[owner[x]] == group[owner[y]]) & self.equal(place[x], place[y], np.full(len(x), self.length))
        repeated = np.zeros(len(owner), bool)
        repeated[x[true]] = True
        for k in np.unique(value[again[~true]]) if not true.all() else ():  # a collision of hashes: compare the bytes
            seen = set()
            for w in np.sort(sort[value == k]):
                text = (group[owner[w]], self.flat[place[w] : place[w] + self.length].tobytes())
                repeated[w] = text in seen
                seen.add(text)
        begin = repeated.copy()
        begin[1:] &= ~(repeated[:-1] & (owner[1:] == owner[:-1]))
        finish = repeated.copy()
        finish[:-1] &= ~(repeated[1:] & (owner[1:] == owner[:-1]))
        b, e = np.flatnonzero(begin), np.flatnonzero(finish)
        yield "repeat", rows[owner[b]], self.low[rows[owner[b]]] + shift[b], self.low[rows[owner[e]]] + shift[e]
        if self.split:
            w = np.flatnonzero(~repeated)
            for k in range(0, len(w), 10_000):  # a window has 100 bytes
                part = w[k : k + 10_000]
                body = gather(self.flat, place[part], np.full(len(part), self.length))
                ends = pa.py_buffer((np.arange(len(part) + 1) * self.length).astype(np.int32))
                body = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, ends, pa.py_buffer(body)])
                yield "first", rows[owner[part]], self.low[rows[owner[part]]] + shift[part], (away[part], body)


_FOUND = "doc long, start long, stop long, seed long, away long, body binary"


def repeated_spans(ws: Workspace, rows: DataFrame, length: int = LENGTH, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc, start, stop) of (doc, text): from start to stop, all windows of a document are repeated."""
    if not SEED_BYTES <= length <= 1000:
        raise ValueError("strings have 32 to 1000 bytes")
    spark, rows = rows.sparkSession, rows.select("doc", "text")

    def count(batches):
        for batch in slices(batches, "text", PIECE):
            flat, ends = raw(batch.column(0))
            for piece, _, hashes, place, _, _ in blocks(flat, ends, length):
                yield pa.RecordBatch.from_arrays([pa.array(_leading(piece, place)), pa.array(hashes[place].view(np.int64))], ["lead", "seed"])

    seeds = rows.select("text").mapInArrow(tidy(count), "lead long, seed long").groupBy("lead", "seed").agg(F.count("*").alias("n")).filter("n > 1")
    seeds = ws.save(seeds, "seeds")
    kinds, total = seeds.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(max(int(np.ceil(np.log2(max(16 * kinds, 1)))), MIN_BITS), MAX_BITS)
    # The lowest bits of a minimizer's hash: the highest are small, as it is a minimum.
    slot = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    words = seeds.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("m"))
    words = words.groupBy("w").agg(F.bit_or("m").alias("m"))
    known = np.zeros(max(1 << (bits - 6), 1), np.uint64)
    for batch in words.toArrow().to_batches():
        known[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)

    # Partitions: ranges between sampled splitters, and several for each minimizer with too many blocks.
    hot = {(r["lead"], r["seed"]): r["n"] for r in seeds.filter(F.col("n") > part_rows).collect()}
    rest = max(int(total - sum(hot.values())), 0)
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rest // part_rows))
    sample = seeds.filter(F.col("n") <= part_rows).sample(False, min(1.0, SPLIT_SAMPLE / max(kinds, 1)), seed=1).limit(2 * SPLIT_SAMPLE).collect()
    sample = sorted((r["lead"], r["seed"], r["n"]) for r in sample)
    mass = np.cumsum([r[2] for r in sample]) if sample else np.zeros(0)
    cuts = sorted({int(np.searchsorted(mass, mass[-1] * k / wanted)) for k in range(1, wanted)}) if len(mass) else []
    pair = np.dtype([("lead", np.int64), ("seed", np.int64)])
    splitters = np.array([sample[k][:2] for k in cuts if k < len(sample)], pair)
    hot_keys = np.array(sorted(hot), pair)
    hot_width = np.array([-(-hot[tuple(map(int, k))] // part_rows) for k in hot_keys], np.int64)
    hot_base = len(splitters) + 1 + np.cumsum(hot_width) - hot_width
    parts = len(splitters) + 1 + int(hot_width.sum())
    shared = spark.sparkContext.broadcast((known, splitters, hot_keys, hot_width, hot_base))

    def scatter(batches):
        known, splitters, hot_keys, hot_width, hot_base = shared.value
        for batch in slices(batches, "text", PIECE):
            flat, ends = raw(batch.column(1))
            docs_ = batch.column(0).to_numpy()
            for piece, start, hashes, place, low, high in blocks(flat, ends, length):
                seed = hashes[place]
                slot_ = seed & np.uint64((1 << bits) - 1)
                keep = (known[(slot_ >> np.uint64(6)).astype(np.int64)] >> (slot_ & np.uint64(63))) & np.uint64(1) > 0
                if not keep.any():
                    continue
                place, low, high, seed = place[keep], low[keep], high[keep], seed[keep].view(np.int64)
                row = np.searchsorted(ends, low + start, side="right") - 1
                key = np.empty(len(seed), pair)
                key["lead"], key["seed"] = _leading(piece, place), seed
                part = np.searchsorted(splitters, key, side="right").astype(np.int64)
                split = np.zeros(len(seed), bool)
                if len(hot_keys):
                    spot = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                    split = hot_keys[spot] == key
                    with np.errstate(over="ignore"):
                        salt = mix(docs_[row].astype(np.uint64) * np.uint64(31) + low.astype(np.uint64)) % hot_width[spot].astype(np.uint64)
                    part = np.where(split, hot_base[spot] + salt.astype(np.int64), part)
                size = high - low + length
                body = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(gather(piece, low, size))])
                arrays = [part.astype(np.int32), docs_[row], low + start - ends[row], place - low, split]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), body], ["part", "doc", "low", "at", "split", "body"])

    def solve(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        part = Partition(pa.Table.from_batches(batches), length)
        del batches
        for kind, r, start, more in part.solve():
            stop, seed, away, body = (more, None, None, None) if kind == "repeat" else (start, part.seed[r], *more)
            for k in range(0, len(r), 100_000):
                s = slice(k, k + 100_000)
                empty = pa.nulls(len(r[s]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.doc[r[s]]), pa.array(start[s]), pa.array(stop[s]), *(empty if x is None else pa.array(x[s]) for x in (seed, away)), pa.nulls(len(r[s]), pa.binary()) if body is None else body],
                    ["doc", "start", "stop", "seed", "away", "body"],
                )

    spread = rows.mapInArrow(tidy(scatter), "part int, doc long, low long, at long, split boolean, body binary")
    found = ws.save(spread.repartitionById(parts, F.col("part")).drop("part").mapInArrow(tidy(solve), _FOUND), "found")
    ws.drop("seeds")
    across = Window.partitionBy("seed", "away", "body").orderBy("doc", "start")
    rest = found.filter("seed is not null").withColumn("k", F.rank().over(across)).filter("k > 1")
    return found.filter("seed is null").unionByName(rest.drop("k")).select("doc", "start", "stop")


def _trim(length: int):
    def work(batches):
        for batch in slices(batches, "text"):
            spans, kept = [], []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs: list[list[int]] = []
                for start, stop in sorted((f["start"], f["stop"] + length) for f in found or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], stop)
                    else:
                        runs.append([start, stop])
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, part_rows: int = PART_ROWS) -> DataFrame:
    """One row a document: doc_id, n_bytes, spans (removed runs of bytes, ends exclusive), kept (the other bytes)."""
    ws = Workspace(docs.sparkSession, "suffix")
    limit_batches(docs.sparkSession)
    rows = numbered(ws, docs, id_col, text_col)
    spans = repeated_spans(ws, rows, length, part_rows).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, "doc", "left").select("doc_id", "text", "found").mapInArrow(
        tidy(_trim(length)), f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )


def span_digests(trimmed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return trimmed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
