"""Language identification by Bayesian evidence fusion.

The posterior of a language given a document is proportional to

* the text's likelihood under byte trigrams, as the mean over all trigrams of the whole text times at
  most ``max_evidence`` (neighbouring trigrams aren't independent, so a long text isn't certain),
* the likelihood of the language that its markup declares (declarations are right with probability
  ``declared_trust``),
* the likelihood of its address's suffix under each language, and
* its host's prior, smoothed towards the domain's, the suffix's and the whole table's.

Priors and suffix likelihoods are grouped sums of text posteriors over the whole table. Trigram models
are trained on a bounded sample of rows with a known language (``max_rows``, in order of a hash of ids).

A document is rejected if it has no letter, if no language reaches ``min_posterior``, or if no language
explains its trigrams better than chance (all trigrams alike), by ``min_gain`` a trigram: so is text in
none of the known languages. Declarations count by their whole first subtag (``fil-PH`` is ``fil``).

Edge cases: a null or empty text has no evidence but the priors and is rejected for want of letters; very
long texts count whole, by their mean; a null host, address or declaration is no evidence; of languages
with the same posterior the first by code point is named; repeated rows and null ids are judged like any
others; without any row of a known language all are rejected; an empty table gives an empty result. Rows
that stay are packed into one column while they are joined, so extra columns of any name never clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.workspace import Workspace, fits

from .arrow import limit_batches, raw, slices, tidy
from .common import BROADCAST_ROWS, packed, parted_by_keys, text_or_empty, unpacked

MAX_ROWS = 4_000
BUCKETS = 1 << 15
MAX_EVIDENCE = 40.0
DECLARED_TRUST = 0.9
PRIOR_STRENGTH = 20.0
MIN_POSTERIOR = 0.5
MIN_GAIN = 0.0
#: Second labels under which countries register names.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Hosts up to which their priors are broadcast.
BROADCAST_HOSTS = 200_000


@dataclass
class TextModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages


def _trigrams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of all rows, and the number of trigrams of each row.

    Runs of bytes that are no letters count as one space; every row gets a space on either side.
    """
    flat, ends = raw(batch.column(batch.schema.get_field_index("text")))
    table = np.full(256, 32, np.uint8)
    table[65:91] = np.arange(97, 123)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    rows = len(ends) - 1
    sizes = np.diff(ends)
    padded = np.full(len(flat) + 2 * rows, 32, np.uint8)
    starts = ends[:-1] + 2 * np.arange(rows) + 1
    padded[np.arange(len(flat)) + np.repeat(2 * np.arange(rows) + 1, sizes)] = table[flat]
    row_of_end = starts - 1
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    keep[row_of_end] = True
    kept = padded[keep].astype(np.uint32)
    begin = np.cumsum(keep)[row_of_end] - 1
    size = np.diff(np.append(begin, len(kept)))
    if len(kept) < 3:
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    code = kept[:-2] * np.uint32(65536) + kept[1:-1] * np.uint32(256) + kept[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(17)
    inside = np.ones(len(bucket), bool)
    last = begin + size  # trigrams must not cross into the next row
    for back in (1, 2):
        spot = last - back
        spot = spot[(spot >= 0) & (spot < len(bucket))]
        inside[spot] = False
    counts = np.maximum(size - 2, 0)
    return bucket[inside].astype(np.int64), counts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> TextModel:
    """Trigram models of the languages in a bounded sample of rows."""
    limit_batches(docs.sparkSession)
    chosen = (
        docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
        .distinct()
    )
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    sample = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]).select(
        text_or_empty(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang")
    )

    def work(batches):
        for batch in slices(batches):
            bucket, counts = _trigrams(batch)
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            owner = np.repeat(np.arange(len(counts)), counts)
            for lang in sorted(set(langs) - {None}):
                got = np.bincount(bucket[(langs == lang)[owner]], minlength=BUCKETS)
                at = np.nonzero(got)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(tidy(work), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for lang, bucket, n in counts.collect():
        found.setdefault(lang, np.zeros(BUCKETS))[bucket] = n
    languages = sorted(found)  # no more than there are rows in the sample
    if not languages:
        return TextModel([], np.zeros((BUCKETS, 0)))
    table = np.stack([found[x] for x in languages], 1) + 0.05
    return TextModel(languages, np.log(table / table.sum(0)))


def host_levels(address: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain and suffix (its last label) of an address.

    A domain is the last two labels, or three where a country's second label is one of ``SECOND_LABELS``.
    """
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(F.length(host) > 0, host)
    shared = host.rlike(r"\.(" + "|".join(SECOND_LABELS) + r")\.[a-z]{2}$")
    domain = F.when(shared, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return host, domain, F.substring_index(host, ".", -1)


def identify(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, declared: Column | None = None, max_evidence: float = MAX_EVIDENCE, declared_trust: float = DECLARED_TRUST, prior_strength: float = PRIOR_STRENGTH, min_posterior: float = MIN_POSTERIOR, min_gain: float = MIN_GAIN) -> DataFrame:
    """One row a document: id, language, posterior, kept."""
    limit_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "language")
    nothing = F.lit(None).cast("string")
    host, domain, suffix, declared = (nothing if c is None else c for c in (host, domain, suffix, declared))
    rows = docs.select(
        text_or_empty(text_col).cast("binary").alias("text"),
        F.col(id_col).alias("_id"),
        host.cast("string").alias("host"),
        domain.cast("string").alias("domain"),
        suffix.cast("string").alias("suffix"),
        F.regexp_extract(F.lower(F.trim(declared.cast("string"))), "^[a-z]+", 0).alias("declared"),
    )
    languages, log_prob = model.languages, model.log_prob.astype(np.float32)
    width = len(languages)

    def work(batches):
        letters = np.zeros(256, bool)
        letters[65:91] = letters[97:123] = letters[128:] = True
        for batch in slices(batches):
            flat, ends = raw(batch.column(0))
            bucket, counts = _trigrams(batch)
            start = np.concatenate([[0], np.cumsum(counts)])
            mean = np.zeros((len(counts), width))
            some = counts > 0
            for k in range(width):
                sums = np.concatenate([[0.0], np.cumsum(log_prob[bucket, k], dtype=np.float64)])
                mean[some, k] = (sums[start[1:][some]] - sums[start[:-1][some]]) / counts[some]
            tally = np.concatenate([[0], np.cumsum(letters[flat])])
            alive = tally[ends[1:]] > tally[ends[:-1]]
            if width:
                alive &= mean.max(1) + math.log(BUCKETS) > min_gain
            evidence = mean * np.minimum(counts, max_evidence)[:, None]
            evidence[~alive] = 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * width, pa.int32()), pa.array(evidence.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, pa.array(alive)], ["_id", "host", "domain", "suffix", "declared", "evidence", "letters"])

    kind = rows.schema["_id"].dataType.simpleString()
    seen = rows.mapInArrow(tidy(work), f"_id {kind}, host string, domain string, suffix string, declared string, evidence array<double>, letters boolean")
    seen = ws.save(seen, "evidence")
    if not languages:
        return seen.select(F.col("_id").alias(id_col), nothing.alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))

    def softmax(scores: Column) -> Column:
        top = F.array_max(scores)
        raised = F.transform(scores, lambda x: F.exp(x - top))
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        return F.transform(raised, lambda x: x / total)

    # Sums of text posteriors by host, domain and suffix, over all rows with letters.
    parts = [F.col("p")[k].alias(f"p{k}") for k in range(width)]
    names = [f"p{k}" for k in range(width)]
    shares = seen.filter("letters").select("host", "domain", "suffix", softmax(F.col("evidence")).alias("p")).select("host", "domain", "suffix", *parts)
    by_host = ws.save(shares.groupBy("host", "domain", "suffix").agg(*[F.sum(c).alias(c) for c in names]), "hosts")
    total = by_host.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]).first()
    root = np.array(total, float) + 1.0
    root = root / root.sum()

    def smoothed(level: str, parent: list[Column], table: DataFrame) -> DataFrame:
        n = sum(F.col(c) for c in names)
        return table.select("*", *[((F.col(c) + prior_strength * parent[k]) / (n + prior_strength)).alias(f"{level}{k}") for k, c in enumerate(names)])

    def level(column: str) -> DataFrame:
        return by_host.filter(F.col(column).isNotNull()).groupBy(column).agg(*[F.sum(c).alias(c) for c in names])

    # Likelihood of a suffix under a language: its smoothed share of the language's mass.
    by_suffix = smoothed("s", [F.lit(float(x)) for x in root], level("suffix")).select("suffix", *[f"s{k}" for k in range(width)])
    parents = by_host.filter("domain is not null").groupBy("domain").agg(F.max("suffix").alias("suffix"))
    by_domain = level("domain").join(parents, "domain").join(by_suffix, "suffix", "left")
    up = [F.coalesce(F.col(f"s{k}"), F.lit(float(root[k]))) for k in range(width)]
    by_domain = smoothed("d", up, by_domain).select("domain", *[f"d{k}" for k in range(width)])
    of_host = level("host").join(by_host.filter("host is not null").groupBy("host").agg(F.max("domain").alias("domain")), "host").join(by_domain, "domain", "left")
    up = [F.coalesce(F.col(f"d{k}"), F.lit(float(root[k]))) for k in range(width)]
    of_host = smoothed("h", up, of_host).select(F.col("host").alias("_host"), F.array(*[F.log(F.col(f"h{k}")) for k in range(width)]).alias("prior"))
    of_host = ws.save(of_host, "priors")
    likely = by_suffix.select(F.col("suffix").alias("_suffix"), F.array(*[F.log(F.col(f"s{k}") / float(root[k])) for k in range(width)]).alias("suffix_score"))
    likely = ws.save(likely, "suffixes")
    hint = F.broadcast if fits(of_host, BROADCAST_HOSTS) and fits(likely, BROADCAST_HOSTS) else (lambda df: df)
    joined = seen.join(hint(of_host), F.col("host") == F.col("_host"), "left").join(hint(likely), F.col("suffix") == F.col("_suffix"), "left")
    base = F.array(*[F.lit(math.log(x)) for x in root])
    zero = F.array(*[F.lit(0.0)] * width)
    codes = F.array(*[F.lit(x) for x in languages])
    subtags = F.array(*[F.lit(x.lower().replace("_", "-").split("-")[0]) for x in languages])
    said = F.when(
        F.array_contains(subtags, F.col("declared")),
        F.transform(subtags, lambda x: F.when(x == F.col("declared"), math.log(declared_trust)).otherwise(math.log((1 - declared_trust) / max(width - 1, 1)))),
    ).otherwise(zero)
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    fused = add(add(F.col("evidence"), said), F.coalesce("prior", add(base, F.coalesce("suffix_score", zero))))
    return (
        joined.select("_id", "letters", softmax(fused).alias("p"))
        .select("_id", "letters", "p", F.array_max("p").alias("posterior"))
        .select(
            F.col("_id").alias(id_col),
            F.element_at(codes, F.array_position("p", F.col("posterior")).cast("int")).alias("language"),
            F.round("posterior", 6).alias("posterior"),
            (F.col("letters") & (F.col("posterior") >= min_posterior)).alias("kept"),
        )
    )


def keep_identified(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", **evidence) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns.

    Rows are told apart by id, text and evidence, so repeated or null ids do no harm. The rejected are
    broadcast if they are few, else joined with the rows that may be among them.
    """
    columns = {name: evidence.pop(name) for name in ("host", "domain", "suffix", "declared") if evidence.get(name) is not None}
    shown = [c.cast("string").alias(name) for name, c in columns.items()]
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(text_or_empty(text_col)).alias("t"), F.struct(F.lit(0), *shown).alias("e")).alias("key")
    ws = Workspace(docs.sparkSession, "language-rejects")
    slim = docs.select(key, text_or_empty(text_col).alias("text"), *shown)
    judged = identify(slim, model, "key", "text", **{name: F.col(name) for name in columns}, **evidence)
    rejected = ws.save(judged.filter("not kept").select(F.col("key").alias("gone")).distinct(), "rejected")
    rows, same = packed(docs, key), F.col("key").eqNullSafe(F.col("gone"))
    if fits(rejected, BROADCAST_ROWS):
        return unpacked(rows.join(F.broadcast(rejected), same, "left_anti"), docs.columns)
    stay, others = parted_by_keys(rows, ["key"], rejected, ["gone"])
    return unpacked(stay.unionByName(others.join(rejected, same, "left_anti")), docs.columns)
