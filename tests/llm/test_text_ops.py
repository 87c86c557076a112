"""Encoding and personal data against plain library calls and regular expressions."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.llm import bpe, pii

LONG = 50


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*bpe.default_ranks(), long_chars=LONG)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c'sé\n\t1!  ", max_size=400))
def test_long_texts_encode_as_short_ones(text):
    own = bpe.codec(*bpe.default_ranks(), LONG)
    assert own.encode(text) == own.encoding.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_texts_without_safe_places(codec):
    for text in ("a" * 5000, " " * 5000, " " * 5000 + "x", "é!" * 3000, "1 " * 4000):
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)


def test_encode_documents(spark):
    rows = [(1, "Hello world", "x"), (2, None, None), (3, "", "y"), (None, "naïve\n\nok", "z"), (1, "Hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.token_digests(bpe.encode_documents(docs)).collect(), key=str)
    own = bpe.codec(*bpe.default_ranks())
    want = []
    for i, text, _ in rows:
        ids = own.encoding.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(r)) or sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def brute(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@x.de", ".", "1", "25", "300.1.2", "7.7.7.7", " ", "-", "+", "+1 (234) 555-0199", "4111 1111 1111 1111", "5500005555555559", "é", "\n", "(", "0"]), max_size=40))
def test_base_spans_are_the_patterns_matches(parts):
    text = "".join(parts)
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute(text)


def test_added_spans():
    text = "IBAN: DE89 3704 0044 0532 0130 00, ftp://bob:pw@host.example.com/x."
    kinds = {k: text[a:b] for k, a, b in pii.find_spans(text)}
    assert kinds["account"] == "DE89 3704 0044 0532 0130 00"
    assert kinds["url"] == "ftp://bob:pw@host.example.com/x"
    assert pii.find_spans("see https://example.com/a/b for more") == []


@pytest.mark.parametrize(("text", "want"), [
    ("the Taliban 2001-2021 war", []),
    ("IBAN DE89 3704 0044 0532 0130 01", []),  # wrong check digits, and no shorter part is tried as another identifier
    ("iban: de89370400440532013000.", [("account", "de89370400440532013000")]),
    ("Iban de89 3704 0044 0532 0130 00 is mine", [("account", "de89 3704 0044 0532 0130 00")]),
    ("AcCoUnT nUmBeR 1234567", [("account", "1234567")]),
    ("İİ kontonummer 1234567", [("account", "1234567")]),
    ('x token = "04dbebab91ab85687d33eeaa" y', [("secret", "04dbebab91ab85687d33eeaa")]),
    ("PASSWORD: hunter2hunter2, next", [("secret", "hunter2hunter2")]),
    ("'api_key': 'abc-def-ghi'", [("secret", "abc-def-ghi")]),
    ("tokenizer = 12345678 and monkey: 12345678", []),
    ("password: something else", []),
])
def test_boundaries_of_added_spans(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text) if k not in pii.BASE_KINDS] == want


def test_secrets_of_the_tables_are_found(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text like '%token = \"%'")
    found = pii.find_personal_data(rows).collect()
    assert found and all(any(s.kind == "secret" and len(s.value) == 40 for s in r.spans) for r in found)


def test_long_digit_runs_are_linear():
    assert pii.find_spans("1" * 200_000 + ".") == []
    assert pii.find_spans("@" * 200_000) == []


def test_find_personal_data(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", 1), (2, None, 2), (3, "", 3), (None, "é 1.2.3.4", 4)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.span_digests(pii.find_personal_data(docs)).collect()}
    assert got[1].spans == "email:5:11" and got[1].n_email == 1
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].spans == "ip:2:9" and got[None].n_ip == 1
