"""Deduplication, mixing, media and suffix operators against brute force, with hard cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mosaiq.llm import exact_dedup, lines, media, minhash, mixing, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, row long"
#: Names that the operators use, or used, for columns of their own.
CLASHING = "_gone gone _key key _m m _source of from _times times _copy id kept_id sha kept_sha tag kept_tag draw doc word level name label n _id _tag _doc _null _salt wanted first".split()


def frame(spark, texts, ids=None, sources=None):
    """Documents with columns whose names clash with the operators' own."""
    schema = SCHEMA + "".join(f", `{c}` int" for c in CLASHING)
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{k % 3}" for k in range(len(texts))] if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, 2, *range(len(CLASHING))) for i, t, s in zip(ids, texts, sources)], schema)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=0, n=60):
    """Random texts, exact copies, copies with changed words, shared passages, odd ones."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.choice([1, 3, 4, 5, 30, 120]))) for _ in range(n // 2)]
    out = [None, "", " ", "\n\n", "a", "A  b\tc", "a b c", "é ü\n中文 " * 30, "x" * 300, "x" * 250, "ab" * 200]
    passage = " ".join(words(rng, 40))
    for text in base:
        out.append(text)
        for _ in range(rng.randrange(3)):
            copy = text.split(" ")
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "w1", "W2"])
            out.append(rng.choice([" ", "  ", "\n"]).join(copy))
        if rng.random() < 0.3:
            out.append(text + "\n" + passage + "\n" + " ".join(words(rng, 9)))
    return out


# -- exact dedup ------------------------------------------------------------------------------------------


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_duplicates(spark, block):
    texts = corpus() + ["b" * 9000, "b" * 9000, "b" * 8999 + "c", "  lead", " lead"]
    got = exact_dedup.exact_duplicates(frame(spark, texts), block_bytes=block).collect()
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    want = {(i, g[0], len(g), i == g[0], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in got} == want and len(got) == len(texts)


def test_exact_duplicates_with_repeated_and_null_ids(spark):
    docs = frame(spark, ["a b", "a b", "a  b", "c", None, ""], [5, 5, None, 5, None, 7])
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert sum(r.kept for r in rows) == 3
    assert {r.keep_id for r in rows if r.group_size == 3} == {5}
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(norm(r.text) for r in kept.collect()) == ["", "a b", "c"]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_drop_exact_duplicates_keeps_rows_whole(spark):
    docs = frame(spark, ["a", "a", "b"])
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(docs).collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id != 1)


# -- mixing -----------------------------------------------------------------------------------------------


def test_mix_matches_its_targets(spark):
    rng = random.Random(3)
    sources = [rng.choice(["a", "b", "é", None, "B", "c"]) for _ in range(2000)]
    texts = [" ".join(words(rng, rng.randrange(0, 30))) or None for _ in sources]
    rows = mixing.mix(frame(spark, texts, sources=sources)).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split()) and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.times <= 3
    times = {r.doc_id: r.times for r in rows}
    total, order = sum(size.values()), sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in free)
        above = {s for s in free if 3 * size[s] < level * weight[s]}
        if not above:
            break
        capped |= above
    for s in order:
        want = 3 * size[s] if s in capped else level * weight[s]
        assert abs(target[s] - want) < 1e-5 and abs(taken[s] - want) <= 30
    again = {(r.doc_id, r.taken) for r in mixing.mix(frame(spark, texts, sources=sources).repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    docs = frame(spark, texts, sources=sources)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and collections.Counter(mixed.collect()) == collections.Counter({r: n for r in docs.collect() for n in [times[r.doc_id]] if n})


def test_mix_of_nothing_and_of_repeated_rows(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = mixing.mix(frame(spark, [None, "", " "])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3
    rows = mixing.mix(frame(spark, ["a b"] * 4, [1, 1, None, None], ["x"] * 4)).collect()
    assert len(rows) == 4 and all(r.taken <= 6 for r in rows)


# -- near duplicates ---------------------------------------------------------------------------------------


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("large", [2, 64])
def test_near_duplicates(spark, monkeypatch, large):
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(1)
    texts = corpus(1)
    hub = words(rng, 200, 10_000)
    for _ in range(40):  # copies that are near the hub and farther from each other
        copy = list(hub)
        for _ in range(rng.choice([1, 3, 5, 8])):
            copy[rng.randrange(200)] = f"z{rng.random()}"
        texts.append(" ".join(copy))
    texts.append(" ".join(hub))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == components(texts)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = " ".join(f"a{k}" for k in range(50))
    docs = frame(spark, [text, text + " b", text, "other words here now yes", None, text], [4, 4, None, 4, None, 9])
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == 6 and {r.component_id for r in rows if r.n_shingles > 40} == {4}
    assert {tuple(r)[8:] for r in minhash.drop_near_duplicates(docs).collect()} == {tuple(range(len(CLASHING)))}
    assert sorted(map(tuple, minhash.drop_near_duplicates(frame(spark, [text, text + " b", "c"])).collect())) == sorted(tuple(r) for r in frame(spark, [text, "-", "c"]).collect() if r.text != "-")
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.text or "")[:5] for r in kept.collect()) == ["", "a0 a1", "other"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.drop_near_duplicates(frame(spark, ["a b", "A b", "c"])).count() == 2


def test_posterior_limits_are_monotone():
    limits = minhash.least_matches()
    assert list(limits) == [32, 64, 96, 128] and sorted(limits.values()) == list(limits.values())
    assert limits[128] < 0.75 * 128


# -- suffixes ----------------------------------------------------------------------------------------------


def removed(texts, length):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        cover = bytearray(len(data))
        for k in range(len(data) - length + 1):
            piece = data[k : k + length]
            if piece in seen:
                cover[k : k + length] = b"\1" * length
            seen.add(piece)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(cover))]
        out.append((len(data), runs, bytes(c for c, x in zip(data, cover) if not x)))
    return out


@pytest.mark.parametrize(("length", "part_rows"), [(100, 60_000), (40, 7)])
def test_remove_repeats(spark, length, part_rows):
    texts = corpus(2) + ["q" * 5000, "=" * 1000 + "-" * 1000, "abcdefghij" * 60, "abcdefghij" * 30 + "x"]
    rows = suffix.remove_repeats(frame(spark, texts), length=length, part_rows=part_rows).collect()
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows}
    assert got == dict(enumerate(removed(texts, length)))


def test_remove_repeats_with_repeated_and_null_ids(spark):
    text = "".join(chr(97 + (k * k) % 26) + str(k) for k in range(80))
    rows = suffix.remove_repeats(frame(spark, [text, text, text, "short", None], [3, 3, None, None, 1])).collect()
    assert sorted(len(r.kept) for r in rows) == [0, 0, 0, 5, len(text)]
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def test_long_text_spans_pieces(spark, monkeypatch):
    rng = random.Random(9)
    unit = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    texts = [unit + unit[1000:2000], "zz" + unit[699_950:] + unit[:60], unit[300:900]]
    rows = {r.doc_id: r for r in suffix.remove_repeats(frame(spark, texts)).collect()}
    for i, (n, runs, kept) in enumerate(removed(texts, 100)):
        assert [(s.start, s.end) for s in rows[i].spans] == runs and hashlib.sha256(bytes(rows[i].kept)).digest() == hashlib.sha256(kept).digest()


# -- lines -------------------------------------------------------------------------------------------------


def kept_lines(texts):
    sets, out = [], []
    for text in texts:
        stay = []
        for line in (text or "").encode().split(b"\n"):
            own = frozenset(re.sub(rb"[A-Z]", lambda m: m[0].lower(), line).split())
            if not own or not any(100 * len(own & s) >= 75 * len(own | s) for s in sets):
                stay.append(line)
            if own:
                sets.append(own)
        out.append(b"\n".join(stay))
    return out


@pytest.mark.parametrize(("first", "group", "frequent"), [(1, 4, 1 << 14), (4, 4, 5), (4, 4096, 1 << 14), (1, 6, 0)])
def test_remove_lines(spark, monkeypatch, first, group, frequent):
    monkeypatch.setattr(lines, "FIRST", first)
    monkeypatch.setattr(lines, "GROUP", group)  # words of more sets are dealt by size and block
    monkeypatch.setattr(lines, "FREQUENT", frequent)
    rng = random.Random(4)
    texts = corpus(3)
    hot = words(rng, 20)
    for _ in range(30):
        line = list(hot)
        line[rng.randrange(20)] = f"v{rng.randrange(99)}"
        texts.append("\n".join([" ".join(line), " ".join(words(rng, rng.randrange(1, 25))), "", " ".join(hot[: rng.randrange(12, 20)])]))
    rows = {r.doc_id: r for r in lines.remove_lines(frame(spark, texts)).collect()}
    for i, want in enumerate(kept_lines(texts)):
        assert bytes(rows[i].kept) == want and rows[i].n_lines == (texts[i] or "").count("\n") + 1


def test_remove_lines_with_repeated_and_null_ids(spark):
    rows = lines.remove_lines(frame(spark, ["a b c\nx", "a b c\nx", "x\ny z", None], [2, 2, None, 1])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 0, 1, 2]
    assert lines.remove_lines(frame(spark, [])).count() == 0


def test_lines_and_suffixes_of_documents_with_string_ids(spark):
    text = "".join(chr(97 + (k * k) % 26) + str(k) for k in range(80))
    docs = spark.createDataFrame([("b", text + "\na b c d"), ("a", "x\na b c d"), (None, "d c b a"), ("b", text)], "doc_id string, text string")
    got = sorted((r.doc_id or "", bytes(r.kept).decode()) for r in lines.remove_lines(docs).collect())
    assert got == [("", ""), ("a", "x\na b c d"), ("b", ""), ("b", text)]  # rows "b" go by their text's hash, one of them second
    rows = suffix.remove_repeats(docs).collect()
    assert sorted(len(r.kept) for r in rows if r.doc_id == "b") in ([0, len(text) + 8], [8, len(text)])
    assert all(r.n_bytes == len(r.kept) for r in rows if r.doc_id != "b")


def test_a_word_in_many_lines(spark):
    """Each line has its own words and one that all have; pairs of lines are similar."""
    n = 20_000
    texts = ["\n".join(f"all x{k} y{k} z{k}" + (" w" if k % 2 else "") for k in range(s, s + 1000)) for s in range(0, n, 1000)]
    texts += ["\n".join(f"z{k} y{k} x{k} all v{k}" for k in range(0, 300, 3))]
    rows = {r.doc_id: r for r in lines.remove_lines(frame(spark, texts)).collect()}
    assert [rows[k].n_removed for k in range(len(texts))] == [0] * (len(texts) - 1) + [sum(k % 2 == 0 for k in range(0, 300, 3))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 1 << 40), st.integers(0, 9), st.integers(-9, 9), st.integers(1, 400), st.integers(0, 50)), min_size=1, max_size=30))
def test_packets_hold_their_rows(rows):
    import numpy as np

    doc, line, node, n, pos = (np.array(c, np.int64) for c in zip(*rows))
    width = lines.image_words(n)
    want = {"doc": doc, "line": line, "node": node, "n": n, "pos": pos, "name": node + 9, "image": np.arange(int(width.sum()), dtype=np.uint64)}
    got = lines.unpack(lines.WORDS, lines.pack(lines.WORDS, want))
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


def test_images_differ_in_no_more_bits_than_sets_in_words():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    texts = []
    for _ in range(60):
        line = words(rng, rng.choice([3, 60, 90, 200, 400, 900]), 5000)
        texts += [" ".join(line), " ".join(line[rng.randrange(len(line) // 5 + 1) :] + words(rng, rng.randrange(9), 5000))]
    own = lines.Lines(pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary())], ["text"]), np.zeros(lines.BINS, np.int64))
    image, _ = own.images()
    images = lines.Images(own.size, image)
    x, y = np.triu_indices(len(texts), 1)
    sets = [set(t.split()) for t in texts]
    apart = np.array([len(sets[a] ^ sets[b]) for a, b in zip(x, y)])
    passed, far = images.near(x, y, apart)
    assert len(passed) == len(x) and (far <= apart).all()
    assert len(images.near(x, y, np.full(len(x), 20))[0]) < len(x) / 4


def test_long_words_that_collide_modulo_2_to_the_64_are_told_apart():
    import numpy as np

    from mosaiq.llm import hashing

    thue = np.array([bin(k).count("1") % 2 for k in range(1 << 11)], np.uint8)
    flat = np.concatenate([thue + 97, [32], 98 - thue]).astype(np.uint8)
    found, _ = hashing.word_hashes(flat, np.array([0, len(flat)]))
    assert len(set(found.tolist())) == 2


# -- media -------------------------------------------------------------------------------------------------


def stored_form(data, payload):
    """Length and digest of the stored form, byte by byte: a manifest and the samples."""
    import struct

    import numpy as np

    table = (media.constants(256, 31) >> np.uint64(32)).tolist()
    chunks, start, h = [], 0, 0
    for k, byte in enumerate(payload):
        h = (h * 2 + table[byte]) % (1 << 32)
        size = k + 1 - start
        if size >= media.LEAST and h % (1 << media.BITS) == 0 or size == media.MOST or k + 1 == len(payload):
            chunks.append(payload[start : k + 1])
            start = k + 1
    head = b"CDC1" + struct.pack("<QQI", len(data), len(payload), len(chunks))
    head += b"".join(hashlib.blake2b(c, digest_size=20).digest() + struct.pack("<I", len(c)) for c in chunks)
    return len(head) + len(payload), hashlib.sha256(head + payload).hexdigest()


def described(payload):
    import math

    n, counts = len(payload), collections.Counter(payload)
    mean = sum(payload) / n
    deviation = math.sqrt(max(sum(b * b for b in payload) / n - mean * mean, 0))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    step = sum(abs(a - b) for a, b in zip(payload, payload[1:])) / max(n - 1, 1)
    return f"mean={mean:.4f};std={deviation:.4f};min={min(payload)};max={max(payload)};entropy={entropy:.4f};step={step:.4f}"


def test_media_round_trip(spark, monkeypatch):
    monkeypatch.setattr(media, "SALT", 2)
    texts = corpus(5) + ["shared passage " * 400 + str(k) * 700 for k in range(6)]
    docs = frame(spark, texts)
    seen, stored = media.store(docs)
    names = [c.name for r in stored.collect() for c in r.owned]
    assert len(names) == len(set(names))  # every chunk is stored once
    assert any(r.borrowed for r in stored.collect())
    rows = {r.doc_id: r for r in media.media_features(docs).collect()}
    alike = collections.defaultdict(set)
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        alike[data].add((r.media_bytes, r.media_sha256, r.feature))
        assert (r.media_bytes, r.media_sha256) == stored_form(data, payload)
        assert r.feature == described(payload)
    assert all(len(v) == 1 for v in alike.values())


def test_media_shuffles_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(media, "BROADCAST_BYTES", 0)
    docs = frame(spark, ["a", "a", None, "b" * 999], [1, 1, None, None])
    assert media.media_features(docs).count() == 4 and media.media_features(docs.limit(0)).count() == 0


@settings(max_examples=50, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=3000), max_size=4))
def test_cuts_cover_payloads(texts):
    import numpy as np

    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    body, places = media.payloads(np.frombuffer(b"".join(texts), np.uint8), ends)
    for start, end, cuts in zip(places, places[1:], media.cuts(body, places)):
        assert cuts[-1] == end and all(0 < b - a <= media.MOST for a, b in zip([start, *cuts], cuts))
        assert all(b - a >= media.LEAST for a, b in zip([start, *cuts], cuts[:-1]))
