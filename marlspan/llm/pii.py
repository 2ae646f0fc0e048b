"""Personal data: patterns propose spans, checksums confirm, context words score.

Each kind has a pattern, a validator (digit counts, Luhn, mod-97, octet range) and
a base score.  Context words of the kind near a span raise its score, words
that speak against it lower it.  The four base kinds (email, ip, card, phone) always
stay once their validator passes; the added kinds (iban, national phone numbers,
social security numbers) need the score to reach the threshold, and those without a
checksum (all but iban) give way to base spans that they overlap.

Defined results.  Null is the empty text and has no spans.  Spans count code
points, the end exclusive.  Very long texts are scanned whole, in time that grows with their length.  Equal rows give equal
spans, an empty table no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .cluster import small_batches

#: The contract's patterns, in the order of its kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national", "ssn")

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The same matches as IP, without going back into a run of digits or starting within one: linear on any text.
_IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20-][0-9]{3}[\x20-][0-9]{3,4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    valid: Callable[[str], bool]
    score: float
    context: tuple[str, ...] = ()
    confirmed: bool = False


CATALOGUE = (
    Kind("email", EMAIL, lambda s: True, 0.9, ("mail", "contact", "write", "@")),
    Kind("ip", IP, lambda s: all(len(d) <= 3 and int(d or "0") <= 255 for d in (p.lstrip("0") for p in s.split("."))), 0.7, ("ip", "host", "server", "address")),
    Kind("card", CARD, _card_ok, 0.8, ("card", "visa", "credit", "payment", "account")),
    Kind("phone", PHONE, lambda s: 9 <= len(_digits(s)) <= 15, 0.8, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", _IBAN, mod97, 0.8, ("iban", "bank", "account", "transfer"), confirmed=True),
    Kind("national", _NATIONAL, lambda s: 9 <= len(_digits(s)) <= 11, 0.3, ("phone", "call", "tel", "mobile", "fax", "contact")),
    Kind("ssn", _SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000", 0.4, ("ssn", "social", "security")),
)
#: Kinds whose spans stay beside any other: the base kinds, and what a checksum confirms.
_STAY = frozenset(k.name for k in CATALOGUE if k.name in BASE or k.confirmed)
_CONTEXT = {k.name: re.compile(r"(?i)\b(?:" + "|".join(re.escape(c) for c in k.context) + r")") for k in CATALOGUE}
_AGAINST = re.compile(r"(?i)\b(?:version|isbn|serial|example|invoice|order)\b")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def _emails(text: str) -> list[tuple[int, int]]:
    """The matches of EMAIL, found from each @ on: runs without one are not scanned."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > after and (c := text[left - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, m.end()))
            after = m.end()
        at = text.find("@", at + 1)
    return out


def _proposed(kind: Kind, text: str, digits: bool) -> list[tuple[int, int]]:
    if kind.name == "email":
        return _emails(text)
    if not digits or kind.name == "phone" and "+" not in text:
        return []
    return [m.span() for m in (_IP_ONCE if kind.name == "ip" else kind.pattern).finditer(text)]


def find(text: str | None, threshold: float = 0.6, near: int = 40) -> list[Span]:
    """All spans, by start, then kind as listed."""
    text = text or ""
    digits, out = bool(_DIGIT.search(text)), []
    for kind in CATALOGUE:
        for start, end in _proposed(kind, text, digits):
            if not kind.valid(text[start:end]):
                continue
            around = f"{text[max(0, start - near) : start]} \n {text[end : end + near]}"
            score = kind.score + 0.35 * bool(_CONTEXT[kind.name].search(around)) - 0.25 * bool(_AGAINST.search(around))
            if kind.name in BASE or score >= threshold:
                out.append(Span(kind.name, start, end, round(min(1.0, max(0.0, score)), 2)))
    base = sorted((s.start, s.end) for s in out if s.kind in BASE)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    # the base spans that begin before a span's end: does one of them reach into it
    before = lambda s: bisect_left(starts, s.end)
    out = [s for s in out if s.kind in _STAY or not (before(s) and reach[before(s) - 1] > s.start)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the union is replaced once."""
    parts, at = [], 0
    for s in spans:
        if s.end <= at:
            continue
        if s.start >= at:
            parts += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(parts) + text[at:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def find_pii(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The spans of each document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [find(t, threshold) for t in b.column(1).to_pylist()]
            base = [[s for s in spans if s.kind in BASE] for spans in found]
            counts = [pa.array([sum(s.kind == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            sha = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array(sha, pa.string()), pa.array([written(s) for s in found], pa.string()), pa.array([[s.score for s in spans] for spans in found], pa.list_(pa.float64()))],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact_documents(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """All documents and columns, the spans replaced; n_chars follows the text, a null text stays null."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for b in batches:
            texts = [None if t is None else redacted(t, find(t, threshold)) for t in b.column(names.index("text")).to_pylist()]
            cols = list(b.columns)
            cols[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
