"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, ``://`` and the words
that announce an identifier. Each anchor starts a parser that looks only at its surroundings.

* email: from an at-sign to the left over local characters (not beyond the end of the last email),
  to the right over domain labels.
* ip, card, phone: from the first digit (or the plus sign) on, then validated: parts at most 255;
  14 to 19 digits that pass the Luhn check; 10 to 15 digits.
* url: a scheme's address that names a user before its host (``ftp://name:secret@host``).
* account: an identifier after its announcing word, in any case; what looks like an IBAN must pass its
  check digits, without spaces or in groups, and nothing else is tried there.
* secret: the value that is assigned to a word such as ``token``, ``password`` or ``api_key``.

Announcing words begin at a word's beginning. Base kinds have no other boundaries than their patterns.

The first four find exactly the leftmost non-overlapping matches of these patterns, a match that
fails validation is dropped without another try::

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)
    card   [0-9]([\\x20-]?[0-9])+
    phone  \\+[0-9][\\x20().0-9-]+[0-9]

The other three add spans. Positions count code points, ends are exclusive. Edge cases: a null text is
empty and has no spans; every row is scanned by itself, whole, whatever its length, and repeated rows alike;
spans with the same start are listed in the order of kinds, equal ones once; an empty table gives an empty
result. Only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import limit_batches, slices, tidy
from .common import text_or_empty

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE_KINDS = KINDS[:4]
#: Words that announce an identifier.
CUES = ("account number", "account no", "acct no", "iban", "passport no", "passport number", "kontonummer", "número de cuenta", "numéro de compte")
#: Words to which a secret is assigned.
SECRETS = ("token", "password", "passwort", "passwd", "pwd", "contraseña", "mot de passe", "secret", "key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#@<>\"']+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?[^\s<>\"']*")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_AFTER_CUE = re.compile(r"[\s.:#=-]{0,4}")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{1,4}){2,8}")
_IDENTIFIER = re.compile(r"[A-Za-z]{0,2}[0-9](?:[ -]?[0-9]){5,16}(?![0-9A-Za-z])")
_ASSIGNED = re.compile(r"[\"']?[^\S\n]{0,3}[:=][^\S\n]{0,3}(?:\"([^\"\n]{6,512})\"|'([^'\n]{6,512})'|((?=[^\s\"'<>,;]{0,511}[0-9])[^\s\"'<>,;]{8,512}))")
_ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, cues in (("cue", CUES), ("secret", SECRETS)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban_end(text: str, match: re.Match) -> int | None:
    """The end of the longest IBAN in a match that ends where a group or word does."""
    start, end = match.span()
    if end < len(text) and text[end].isalnum():  # the match ends within a word
        end = text.rfind(" ", start, end)
    while end > start:
        if _iban(text[start:end].replace(" ", "")):
            return end
        end = text.rfind(" ", start, end)
    return None


def _lowered(text: str) -> str:
    """The text in lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then by kind as listed in KINDS."""
    spans: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = url_end = 0
    for last, (anchor, width) in _automaton().iter(_lowered(text)):
        at = last - width + 1
        if anchor == "digit":
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, card_end))
            if at >= ip_end:
                if m := _IP.match(text, at):
                    ip_end = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                        spans.append(("ip", at, ip_end))
                else:
                    ip_end = _DIGITS.match(text, at).end()
        elif anchor == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans.append(("email", start, email_end))
        elif anchor == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append(("phone", at, phone_end))
        elif anchor == "scheme":
            start = at
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _AUTHORITY.match(text, at + 3)):
                url_end = m.end()
                while text[url_end - 1] in ".,;:!?)":
                    url_end -= 1
                spans.append(("url", start, url_end))
        elif at and text[at - 1].isalnum():
            continue
        elif anchor == "secret":
            if m := _ASSIGNED.match(text, last + 1):
                spans.append(("secret", *m.span(m.lastindex)))
        else:
            start = _AFTER_CUE.match(text, last + 1).end()
            if m := _IBAN.match(text, start):
                if (end := _iban_end(text, m)) is not None:
                    spans.append(("account", start, end))
            elif m := _IDENTIFIER.match(text, start):
                spans.append(("account", start, m.end()))
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, spans (array of kind, start, end, value)."""

    limit_batches(docs.sparkSession)

    def work(batches):
        for batch in slices(batches):
            found = []
            for data in batch.column(1).to_pylist():
                text = data.decode("utf-8", "replace")
                found.append([(k, a, b, text[a:b]) for k, a, b in find_spans(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[dict(zip(("kind", "start", "end", "value"), s)) for s in row] for row in found], pa.list_(SPAN))],
                ["doc_id", "spans"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(work), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans as kind:start:end joined by commas."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
