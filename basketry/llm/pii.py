"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Four base kinds (email, ip, card, phone) are kept whenever their pattern and check agree.
Further kinds need a score: a proposal starts with its kind's value, a passed checksum and
a context word near it raise it, and spans under ``THRESHOLD`` are dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
NEAR = 48  # characters on either side that are searched for context words

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and look-behinds keep the searches linear; they match the same spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 check of an IBAN."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @, found without trying every start of a long run."""
    end, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at + 1)
        if found:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = found.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


@dataclass(frozen=True)
class Kind:
    """A further kind: what proposes it, what confirms it, which words near it count."""

    name: str
    pattern: re.Pattern
    needs: Callable[[str], bool]  # cheap test whether the text can hold one at all
    start: float
    check: Callable[[re.Match], bool] | None = None
    confirmed: float = 0.0
    words: re.Pattern | None = None
    near: float = 0.0


def _context(*words: str) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(words) + r")(?!\w)", re.I)


def _iban(m: re.Match) -> bool:
    plain = m.group().replace(" ", "")
    return 15 <= len(plain) <= 34 and mod97(plain)


def _ssn(m: re.Match) -> bool:
    a, b, c = m.group().split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


EXTRA = (
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
         lambda t: _DIGIT.search(t) is not None, 0.1, _iban, 0.7, _context("iban", "account", "konto", "compte", "cuenta"), 0.2),
    Kind("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), lambda t: "-" in t,
         0.1, _ssn, 0.2, _context("ssn", "social", "security"), 0.4),
    Kind("key", re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), lambda t: "AKIA" in t,
         0.6, None, 0.0, _context("key", "aws", "secret"), 0.2),
    Kind("secret", re.compile(r"""(?<![A-Za-z0-9])(?:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}["']?(?P<value>[^\s"',;]{8,}+)["']?""", re.I),
         lambda t: "=" in t or ":" in t, 0.4, lambda m: _DIGIT.search(m.group()) is not None, 0.3, None, 0.0),
    Kind("local_phone", re.compile(r"(?<![0-9+])\(?[0-9]{3,5}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"),
         lambda t: _DIGIT.search(t) is not None, 0.2, None, 0.0, _context("call", "phone", "tel", "telefon", "mobile", "fax"), 0.4),
)


def extra(text: str, kind: Kind) -> Iterator[tuple[int, int, tuple[int, int] | None]]:
    """Spans of a kind, with that of the value where its pattern names one."""
    if not kind.needs(text):
        return
    for m in kind.pattern.finditer(text):
        score = kind.start
        if kind.check:
            if not kind.check(m):
                continue
            score += kind.confirmed
        if kind.words and kind.words.search(text[max(0, m.start() - NEAR) : m.start()] + "\n" + text[m.end() : m.end() + NEAR]):
            score += kind.near
        if score >= THRESHOLD:
            yield m.start(), m.end(), m.span("value") if "value" in m.re.groupindex else None


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span overlaps any of the sorted ones; those may overlap each other a little."""
    at = bisect.bisect_left(taken, (end, 0))
    return any(e > start for _, e in taken[max(0, at - len(BASE)) : at])


def _uncovered(taken: list[tuple[int, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
    """The parts of a span that none of the sorted ones covers."""
    first, last = bisect.bisect_left(taken, (start, 0)), bisect.bisect_left(taken, (end, 0))
    for s, e in taken[max(0, first - len(BASE)) : last]:
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start.

    A proposal of a further kind that overlaps a span found before it is not added; of a
    secret that holds one within its value, what is left of the value on either side is.
    """
    text = text or ""
    digits = _DIGIT.search(text) is not None
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if digits:
        found += [("ip", *s) for s in addresses(text)]
        found += [("card", *s) for s in cards(text)]
        found += [("phone", *s) for s in phones(text)] if "+" in text else []
    taken = sorted((s, e) for _, s, e in found)
    for kind in EXTRA:
        new = []
        for s, e, value in extra(text, kind):
            if not _overlaps(taken, s, e):
                new.append((s, e))
            elif value:
                new += [(a, b) for a, b in _uncovered(taken, s, e) if b > value[0] and a < value[1]]
        found += [(kind.name, s, e) for s, e in new]
        taken = sorted(taken + new)
    return found


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are one."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other) per input row.

    A null text is empty; a row without spans has an empty list; repeated rows give equal
    rows; null ids stay null; other columns are not read; an empty table gives an empty
    result.  Only narrow tasks, and every pattern is linear in the text's length.
    """
    ids = docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        for b in batches:
            all_found = [spans(t.as_py()) for t in b.column(1)]
            base = [[x for x in found if x[0] in BASE] for found in all_found]
            counts = [pa.array([sum(x[0] == k for x in found) for found in base], pa.int64()) for k in BASE]
            digest = [hashlib.sha256(listed(found).encode()).hexdigest() for found in base]
            other = [len(f) - len(g) for f, g in zip(all_found, base)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array(digest, pa.string()), pa.array(map(listed, all_found), pa.string()), pa.array(other, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_other"])

    counted = ", ".join(f"n_{k} bigint" for k in BASE)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, f"doc_id {ids}, {counted}, base_sha256 string, spans string, n_other bigint")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of the text column replaced; every other column as it is."""
    names = docs.columns

    def work(batches):
        for b in batches:
            i = b.schema.get_field_index(text)
            new = pa.array([redact(t.as_py()) for t in b.column(i)], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays([new if j == i else c for j, c in enumerate(b.columns)], names)

    return docs.mapInArrow(work, docs.schema)
