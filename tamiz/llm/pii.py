"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are taken as their patterns and checks say; context cannot remove them.
Kinds that the method adds, with a starting score, a checksum and context words within ``reach`` characters before the span:

* ``iban`` 0.4, +0.5 when mod-97 confirms it, else refused;
* ``bank_card`` 0.3, 13 to 15 digits passing Luhn and starting with 3, 4, 5 or 6; +0.3 for a grouped form or a card word nearby;
* ``local_phone`` 0.2, 8 to 12 digits in groups without a plus; +0.4 for a phone word nearby;
* ``national_id`` 0.2, three groups 3-2-4 of a US number (ranges checked) or 8 digits and the control letter mod 23 (confirmed:
  +0.5); +0.4 for an identity word nearby;
* ``secret`` 0.2, an access key id or a value assigned to password, token, secret or api key: those words are its context, +0.5.

A span is reported when its score reaches ``threshold``. Added spans that overlap a base span, or an added span of a higher
score (ties: the earlier, then the longer), are left out. Offsets are code points, end exclusive.

Null and empty texts give no spans. Only the id and text columns are read, so clashing names of other columns do no harm.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tamiz.llm import words as W

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "bank_card", "local_phone", "national_id", "secret")
REACH = 40
THRESHOLD = 0.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number that fails from its first digit fails from its later ones, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGIT = re.compile(r"[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_US_ID = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_DNI = re.compile(r"(?<![0-9A-Za-z])([0-9]{8})-?([A-Za-z])(?![0-9A-Za-z])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20-][0-9]{2,4}(?:[\x20-][0-9]{2,4}){0,3}(?![0-9A-Za-z.-])")
_KEY_ID = re.compile(r"(?<![A-Z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Z0-9])")
_ASSIGNED = re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]\x20?[\"']?([^\s\"']{6,})", re.IGNORECASE)
_CONTEXT = {
    "bank_card": re.compile(r"card|visa|amex|credit|debit|tarjeta|carte|karte", re.IGNORECASE),
    "local_phone": re.compile(r"phone|\btel\b|mobile|\bcall\b|\bfax\b|tel[eé]fono|t[eé]l[eé]phone|telefon|handy", re.IGNORECASE),
    "national_id": re.compile(r"\bssn\b|social security|\bdni\b|\bnif\b|identity|identidad|ausweis", re.IGNORECASE),
}
_CONTROL_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: control letters of the Spanish identity number, by remainder mod 23


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each ``@`` outwards, so long words without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    out = [Span("email", a, b, 1.0) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(Span("ip", m.start(), m.end(), 1.0))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", m.start(), m.end(), 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdecimal() for c in m.group()) <= 15:
                out.append(Span("phone", m.start(), m.end(), 1.0))
    return out


def _near(kind: str, text: str, start: int, reach: int) -> bool:
    return _CONTEXT[kind].search(text, max(0, start - reach), start) is not None


def proposals(text: str, reach: int = REACH) -> list[Span]:
    """Spans of the added kinds with their adjusted scores."""
    out = []
    low = text if text.islower() else text.lower()
    if any(w in low for w in ("password", "passwd", "pwd", "secret", "token", "api")):
        out += [Span("secret", m.start(1), m.end(1), 0.7) for m in _ASSIGNED.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        out += [Span("secret", m.start(), m.end(), 0.7) for m in _KEY_ID.finditer(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IBAN.finditer(text):
        plain = m.group().replace(" ", "")
        # Blanks may have drawn the next words in: the longest valid head of the match counts.
        for n in range(min(len(plain), 34), 14, -1):
            if mod97(plain[:n]):
                end, seen = m.start(), 0
                while seen < n:
                    seen += text[end] != " "
                    end += 1
                out.append(Span("iban", m.start(), end, 0.9))
                break
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 15 and digits[0] in "3456" and luhn(digits):
                sure = len(digits) != m.end() - m.start() or _near("bank_card", text, m.start(), reach)
                out.append(Span("bank_card", m.start(), m.end(), 0.6 if sure else 0.3))
    for m in _US_ID.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            out.append(Span("national_id", m.start(), m.end(), 0.6 if _near("national_id", text, m.start(), reach) else 0.2))
    for m in _DNI.finditer(text):
        if _CONTROL_LETTERS[int(m.group(1)) % 23] == m.group(2).upper():
            out.append(Span("national_id", m.start(), m.end(), 0.7))
    for m in _LOCAL_PHONE.finditer(text):
        if 8 <= sum(c.isdecimal() for c in m.group()) <= 12:
            out.append(Span("local_phone", m.start(), m.end(), 0.6 if _near("local_phone", text, m.start(), reach) else 0.2))
    return out


def find_spans(text: str | None, threshold: float = THRESHOLD, reach: int = REACH) -> list[Span]:
    """All spans of a text: base kinds in their order, then added kinds in theirs, each by start."""
    if not text:
        return []
    base = base_spans(text)
    added: list[Span] = []
    # Base spans may overlap one another; merged, they can be searched by place.
    taken: list[tuple[int, int]] = []
    for s in sorted(base, key=lambda s: s.start):
        if taken and s.start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], s.end))
        else:
            taken.append((s.start, s.end))
    for s in sorted(proposals(text, reach), key=lambda s: (-s.score, s.start, -s.end)):
        k = bisect.bisect_left(taken, (s.end, 0))
        if s.score >= threshold and (k == 0 or taken[k - 1][1] <= s.start):
            added.append(s)
            taken.insert(k, (s.start, s.end))
    order = {k: n for n, k in enumerate(BASE_KINDS + ADDED_KINDS)}
    return sorted(base + added, key=lambda s: (order[s.kind], s.start))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each found stretch replaced by its kind in brackets; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at:s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, spans array<struct<kind, start, end, score>>, redacted)`` of every document."""
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            texts = part.column(1).to_pylist()
            found = [find_spans(t, threshold) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([[s._asdict() for s in x] for x in found], kind),
                 pa.array([redact(t, x) for t, x in zip(texts, found)], pa.string())], names=["id", "spans", "redacted"])

    return (src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, "
                           "spans array<struct<kind: string, start: long, end: long, score: double>>, redacted string")
            .withColumnRenamed("id", id_column))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts and listings per document, without the texts."""
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    names = [f"n_{k}" for k in BASE_KINDS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            found = [find_spans(t, threshold) for t in part.column(1).to_pylist()]
            base = [[s for s in x if s.kind in BASE_KINDS] for x in found]
            counts = [pa.array([sum(s.kind == k for s in x) for x in base], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, pa.array(map(listed, found), pa.string())],
                                             names=["id", *names, "base_sha256", "spans"])

    return (src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}, "
                           "base_sha256 string, spans string").withColumnRenamed("id", id_column))


def redacted(docs: DataFrame, text_column: str = "text", length_column: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in the text; ``length_column`` follows the new text, where not null."""
    place = docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, text_column):
            texts = [redact(t, find_spans(t, threshold)) for t in part.column(place).to_pylist()]
            columns = part.columns
            columns[place] = pa.array(texts, part.schema.field(place).type)
            if length_column is not None:
                k = part.schema.get_field_index(length_column)
                sizes = [None if t is None or old is None else len(t) for t, old in zip(texts, columns[k].to_pylist())]
                columns[k] = pa.array(sizes, part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(work, docs.schema)


def op10_pii(spark, folder: str) -> DataFrame:
    """Personal data of every document, as counts, a digest of the base spans and a list of all spans."""
    from tamiz.llm.store import table
    return report(table(spark, folder, "documents"))
