"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is that of its distinct shingles of five words (A-Z lower-cased); two documents are
linked if their sets' Jaccard similarity is at least 0.75, and groups are connected components.

1. One pass hashes every whole text: the set's size, a 128-bit identity of the set, 128 minima and the
   keys of 32 bands of 4. A pair at the threshold shares no band with probability 5e-6.
2. Documents with the same set are one class; only classes are compared.
3. Each bucket of a band links its members to one of them (a star, not all pairs). Pairs are verified
   sequentially: 32 minima at a time are compared, and a pair is pruned as soon as the posterior
   probability of a similarity of at least 0.75 falls below ``miss``. Survivors are verified on
   full sets.
4. Buckets whose members then lie in several components are starred again around another member. In
   whatever buckets still hold several components, all pairs across components are compared in groups
   of ``BLOCK`` members that travel with their minima, so no link is lost and pairs that the posterior
   prunes are never rows. Groups of large buckets carry the full sets too and verify in place. Members
   of one component need no comparison: it can't change the result.

Sets are compared by 64-bit hashes of their shingles. Edge cases: a null text or one without words has
an empty set and is linked with nothing; with fewer than five words the whole sequence is the one
shingle; equal rows are linked as any others, and ties between members go to the smallest id; rows with null
ids take part in groups, whose id is the smallest that isn't null; very long texts are hashed whole, 256 KB at
a time; an empty table gives an empty result. Rows that stay are packed into one column while they are joined,
so extra columns of any name never clash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.workspace import Workspace, fits

from .arrow import limit_batches, raw, slices, tidy
from .common import BROADCAST_ROWS, join_groups, packed, parted_by_keys, text_or_empty, unpacked
from .exact_dedup import drop_ids
from .graph import components
from .hashing import constants, mix, shingle_hashes, word_hashes

WIDTH = 5
THRESHOLD = 0.75
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Probability at which a true pair may be pruned.
MISS = 1e-6
#: Minima compared at a time.
STEP = 32
#: Stars around one member of each bucket before all pairs across components are compared.
ROUNDS = 2
#: Members of a bucket that are compared in one group.
BLOCK = 512
#: Members from which on a bucket's groups carry full sets.
LARGE = 64
#: Pairs whose minima are compared at once in a task.
COMPARED = 1 << 14


def _sets(batch: pa.RecordBatch, column: str = "text"):
    """The sorted distinct shingle hashes of each row."""
    flat, ends = raw(batch.column(batch.schema.get_field_index(column)))
    with np.errstate(over="ignore"):
        words, begin = word_hashes(flat, ends)
        for a, b in zip(begin[:-1], begin[1:]):
            yield np.unique(shingle_hashes(words[a:b], WIDTH))


def _identity(members: np.ndarray) -> tuple[int, int]:
    one, two = mix(members ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix(members + np.uint64(0x14057B7EF767814F)).sum()
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _minima(members: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(members), 4096):
        np.minimum(least, (members[None, start : start + 4096] * factors[:, None]).min(1), out=least)
    return least


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, tag (of the raw text), n_shingles, k1, k2, minima (one byte each), bands."""
    limit_batches(docs.sparkSession)
    text = text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def work(batches):
        factors, join = constants(MINIMA, 4242), constants(ROWS, 99)
        for batch in slices(batches):
            size, one, two, marks, bands = [], [], [], [], []
            with np.errstate(over="ignore"):
                for members in _sets(batch):
                    k1, k2 = _identity(members)
                    size.append(len(members))
                    one.append(k1)
                    two.append(k2)
                    least = _minima(members, factors)
                    marks.append((mix(least) & np.uint64(255)).astype(np.uint8).tobytes())
                    bands.append(mix((least.reshape(BANDS, ROWS) * join).sum(1)).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(marks, pa.binary()), lists],
                ["doc_id", "tag", "n_shingles", "k1", "k2", "minima", "bands"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(work), f"doc_id {kind}, tag long, n_shingles long, k1 long, k2 long, minima binary, bands array<long>")


@lru_cache(maxsize=4)
def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> dict[int, int]:
    """For 32, 64, ... compared minima, the fewest matches at which a pair stays.

    With a uniform prior the posterior of similarity s after m matches of n is proportional to
    r^m (1-r)^(n-m), r = s + (1-s)/256 being the chance that one byte of two minima agrees.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    r = s + (1 - s) / 256
    out = {}
    for n in range(STEP, MINIMA + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(r) + (n - m) * np.log1p(-r)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() >= miss * weight.sum():
                out[n] = m
                break
    return out


def _alive(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The places of pairs of minima that are not pruned."""
    alive = np.arange(len(one))
    matches = np.zeros(len(one), np.int64)
    for n, least in least_matches().items():
        part = slice(n - STEP, n)
        matches[alive] += (one[alive, part] == two[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, MINIMA)


def _prune(batches):
    for batch in batches:
        if batch.num_rows:
            keep = np.zeros(batch.num_rows, bool)
            keep[_alive(_bytes(batch.column(2)), _bytes(batch.column(3)))] = True
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])


def _groups(batches, rows: int = 1, keys: tuple[str, ...] = ("bucket", "i", "j")):
    """Tables of at least ``rows`` rows (but the last) sorted by ``keys``, no group cut."""
    rest, waiting = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in waiting) < rows:
            continue
        table = pa.concat_tables(([rest] if rest is not None else []) + waiting).combine_chunks()
        waiting = []
        same = np.ones(table.num_rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            same &= column == column[-1]
        cut = table.num_rows - int(same.sum())
        rest = table.slice(cut).combine_chunks()
        if cut:
            yield table.slice(0, cut).combine_chunks()
    if rest is not None or waiting:
        yield pa.concat_tables(([rest] if rest is not None else []) + waiting).combine_chunks()


def _pairs(table):
    """Places of pairs that the posterior keeps: within each group those across labels and, if i < j, across blocks."""
    i, j, block, label = (table.column(k).to_numpy() for k in ("i", "j", "block", "label"))
    minima = _bytes(table.column("minima"))
    key = np.stack([table.column("bucket").to_numpy(), i, j], 1)
    edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
    for a, b in zip([0, *edge], [*edge, len(i)]):
        if b - a < 2:
            continue
        x, y = np.triu_indices(b - a, 1)
        x, y = x + a, y + a
        wanted = label[x] != label[y]
        if i[a] != j[a]:
            wanted &= block[x] != block[y]
        x, y = x[wanted], y[wanted]
        for k in range(0, len(x), COMPARED):
            u, v = x[k : k + COMPARED], y[k : k + COMPARED]
            stay = _alive(minima[u], minima[v])
            if len(stay):
                yield u[stay], v[stay]


def _across(batches):
    """Likely pairs of groups without sets."""
    for table in _groups(batches):
        node = table.column("node").to_numpy()
        yield from _unique((node[x], node[y]) for x, y in _pairs(table))


def _links_across(batches):
    """Links of groups with sets. A pair is verified in the first bucket that it shares."""
    for table in _groups(batches):
        node, band = table.column("node").to_numpy(), table.column("band").to_numpy()
        bands = table.column("bands").combine_chunks()
        bands = (bands.chunk(0) if isinstance(bands, pa.ChunkedArray) else bands).flatten().to_numpy().reshape(-1, BANDS)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        found = []
        for x, y in _pairs(table):
            here = (bands[x] == bands[y]).argmax(1) == band[x]
            x, y = x[here], y[here]
            true = np.fromiter((_similar(sets[a], sets[b]) for a, b in zip(x.tolist(), y.tolist())), bool, len(x))
            found.append((node[x[true]], node[y[true]]))
        yield from _unique(found)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < 75 * len(y):
        return False
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= 75 * (len(x) + len(y) - common)


def _unique(found):
    """Pairs (smaller, larger) without repeats, one batch for all groups at hand."""
    found = list(found)
    if found:
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _confirm(batches):
    for batch in slices(batches, "one", 2 << 20):
        keep = [
            _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        ]
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])


class Linker:
    """Verified links between classes, step by step."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
        self.ws = Workspace(docs.sparkSession, "near")
        rows = sketch(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
        self.rows = self.ws.save(rows, "rows")
        filled = self.rows.filter("n_shingles > 0")
        classes = filled.groupBy("k1", "k2").agg(F.min("row").alias("node"))
        self.classes = self.ws.save(classes, "classes")
        self.nodes = self.rows.join(self.classes.select(F.col("node").alias("row")), "row", "left_semi")
        self.step = 0

    def name(self, what: str) -> str:
        self.step += 1
        return f"{what}{self.step}"

    def buckets(self) -> DataFrame:
        """(bucket, band, node) of all buckets with several members."""
        spread = self.nodes.select(F.col("row").alias("node"), F.posexplode("bands").alias("band", "key"))
        spread = spread.select("node", "band", F.xxhash64("band", "key").alias("bucket"))
        shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
        return self.ws.save(spread.join(shared, "bucket"), "buckets")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sequential verification doesn't prune."""
        pairs = self.ws.save(pairs, self.name("pairs"))
        marks = self.nodes.select("row", "minima")
        sides = pairs.join(marks.select(F.col("row").alias("a"), F.col("minima").alias("x")), "a").join(
            marks.select(F.col("row").alias("b"), F.col("minima").alias("y")), "b"
        )
        return sides.select("a", "b", "x", "y").mapInArrow(tidy(_prune), "a long, b long")

    def _grouped(self, members: DataFrame) -> DataFrame:
        """Rows of ``members`` (bucket, band, node, label, n, ..) in groups of at most two blocks, sorted by group."""
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        placed = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        groups = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "n")
        return groups.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def links_across(self, members: DataFrame) -> DataFrame:
        """Links across labels in the buckets of ``members`` (bucket, band, node, label, n)."""
        members = self.ws.save(members, self.name("across"))
        marks = self.nodes.select(F.col("row").alias("node"), "minima", "bands")
        few = members.filter(F.col("n") <= LARGE).join(marks.drop("bands"), "node")
        links = self.confirm(self._grouped(few).mapInArrow(tidy(_across), "a long, b long").distinct())
        many = members.filter(F.col("n") > LARGE)
        sets = self._full_sets(many.select(F.col("node").alias("row")))
        many = many.join(marks, "node").join(sets, "node")
        return self.ws.save(links.unionByName(self._grouped(many).mapInArrow(tidy(_links_across), "a long, b long")).distinct(), self.name("links"))

    def confirm(self, likely: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        likely = self.ws.save(likely, self.name("likely"))
        sets = self._full_sets(likely.select(F.col("a").alias("row")).unionByName(likely.select(F.col("b").alias("row"))))
        sides = likely.join(sets.select(F.col("node").alias("a"), F.col("members").alias("one")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("members").alias("two")), "b"
        )
        return self.ws.save(sides.select("a", "b", "one", "two").mapInArrow(tidy(_confirm), "a long, b long"), self.name("links"))

    def _full_sets(self, rows: DataFrame) -> DataFrame:
        """(node, members) of the nodes in ``rows`` (row), from their texts."""
        wanted = self.ws.save(self.nodes.join(rows.distinct(), "row").select("row", "doc_id", "k1", "k2"), self.name("wanted"))
        ids = wanted.select(F.col("doc_id").alias("wanted")).distinct()
        some = self.docs
        if fits(ids, BROADCAST_ROWS):
            ids = F.broadcast(ids)
        else:
            _, some = parted_by_keys(some, ["doc_id"], ids, ["wanted"])
        some = some.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")

        def work(batches):
            for batch in slices(batches):
                one, two, found = [], [], []
                with np.errstate(over="ignore"):
                    for members in _sets(batch):
                        k1, k2 = _identity(members)
                        one.append(k1)
                        two.append(k2)
                        found.append(members.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(found, pa.binary())], ["k1", "k2", "members"])

        sets = some.select("text").mapInArrow(tidy(work), "k1 long, k2 long, members binary")
        sets = sets.join(wanted.select("row", "k1", "k2"), ["k1", "k2"]).select(F.col("row").alias("node"), "members")
        if not fits(wanted.groupBy("doc_id").count().filter("count > 1"), 0) or self._repeats():
            sets = sets.dropDuplicates(["node"])
        return sets

    def _repeats(self) -> bool:
        """Whether ids repeat or are null, so that a set may be read twice."""
        if not hasattr(self, "_repeated"):
            self._repeated = not self.rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty()
        return self._repeated

    def labels(self) -> DataFrame:
        """(node, label): the component of every class that has a link."""
        ws, buckets = self.ws, self.buckets()
        label = None
        for turn in range(ROUNDS + 1):
            members = buckets.withColumn("label", F.col("node"))
            if label is not None:
                members = buckets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
            open_ = members.groupBy("bucket").agg(
                F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "label")).alias("center")
            ).filter("low < high")
            if turn == 0:
                open_ = open_.withColumn("center", F.struct(F.lit(0).alias("h"), F.col("low").alias("node"), F.col("low").alias("label")))
            open_ = ws.save(open_.select("bucket", "n", F.col("center.node").alias("c"), F.col("center.label").alias("of")), self.name("open"))
            if open_.isEmpty():
                break
            across = members.join(open_, "bucket")
            if turn < ROUNDS:
                pairs = across.filter("label != of").select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b"))
                links = self.confirm(self.likely(pairs.distinct()))
            else:
                links = self.links_across(across.select("bucket", "band", "node", "label", "n"))
            if label is None:
                label = ws.save(components(ws, links, self.name("cc")), self.name("labels"))
                continue
            on_a = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
            on_b = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            lifted = links.join(on_a, "a", "left").join(on_b, "b", "left")
            lifted = lifted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            if lifted.isEmpty():
                continue
            merged = components(ws, lifted, self.name("cc")).select(F.col("node").alias("label"), F.col("label").alias("to"))
            old = label.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            new = merged.select(F.col("label").alias("node"), F.col("to").alias("label")).join(label, "node", "left_anti")
            label = ws.save(old.unionByName(new), self.name("labels"))
        return label if label is not None else ws.spark.createDataFrame([], "node long, label long")

    def result(self) -> DataFrame:
        """One row a document: doc_id, tag, row, n_shingles, component_id, first (the row that stays of its group)."""
        self._repeats()
        label = self.labels()
        of_class = self.classes.join(label, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("label"))
        slim = self.rows.select("doc_id", "tag", "row", "n_shingles", "k1", "k2")
        placed = (
            slim.filter("n_shingles > 0").join(of_class, ["k1", "k2"])
            .unionByName(slim.filter("n_shingles = 0").withColumn("label", F.col("row")))
        )
        placed = self.ws.save(placed.select("doc_id", "tag", "row", "n_shingles", "label"), "placed")
        self.ws.keep("placed")
        order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
        groups = self.ws.save(placed.groupBy("label").agg(F.min(order).alias("m"), F.count("*").alias("n")), "groups")
        return join_groups(placed, groups, ["label"], "n").select("doc_id", "tag", "n_shingles", F.col("m.doc_id").alias("component_id"), (F.col("row") == F.col("m.row")).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    return Linker(docs, id_col, text_col).result().select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group (that with the smallest id), with all its columns."""
    linker = Linker(docs, id_col, text_col)
    found = linker.ws.save(linker.result(), "found")
    if not linker._repeats():
        return drop_ids(docs, found.filter("not first").select("doc_id"), id_col)
    keys = found.filter("first").select(F.col("doc_id").alias("kept_id"), F.col("tag").alias("kept_tag"))
    rows = packed(docs, F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col).cast("binary")).alias("tag"))
    stay = rows.join(keys, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("tag") == F.col("kept_tag")), "left_semi")
    return unpacked(stay.dropDuplicates(["id", "tag"]), docs.columns)
