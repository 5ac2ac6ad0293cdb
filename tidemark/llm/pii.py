"""Personal data, plain and disguised, with exact source offsets.

Plain identifiers are matched in the source itself. Disguised ones are found by transducers: each reads the text and
writes a normalised one, remembering for every rewritten stretch where it came from (``Rewrite``). Homoglyphs, full-width
forms, other digits and invisible characters are folded first, then spelled digit runs, then bracketed or spelled at and
dot signs. Matches in the normalised text that touch a rewritten stretch are mapped back to code points of the source.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import text_of

# Kinds in listing order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Look-alike letters (Cyrillic and Greek), dots, hyphens, spaces and invisible characters.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαοιυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaoivABEZHIKMNOPTYX"))
_SIGNS = {"․": ".", "。": ".", "｡": ".", " ": " ", " ": " ", " ": " ", "　": " "}
_SIGNS |= dict.fromkeys("‐‑‒–—−", "-")
_HIDDEN = dict.fromkeys("­​‌‍⁠﻿", "")
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_DIGITS = {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966, 0x9E6, 0xE50) for d in range(10)}
FOLD = {**_LOOKALIKE, **_SIGNS, **_HIDDEN, **_WIDE, **_DIGITS}
SPELLED = {w: str(d) for d, w in enumerate("zero one two three four five six seven eight nine".split())}

_FOLDED = re.compile(f"[{re.escape(''.join(FOLD))}]")
_NUMBER = "|".join(SPELLED)
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:{_NUMBER})(?:[\x20-]{{1,2}}(?:{_NUMBER}|[0-9](?![0-9]))){{2,}}(?![^\W_])", re.I)
_SPELLED_ONE = re.compile(rf"{_NUMBER}|[0-9]", re.I)
_AT = re.compile(r"\x20?[\[({<]\x20?at\x20?[\])}>]\x20?|\x20at\x20|@", re.I)
_DOT = r"(?:\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20dot\x20|\.)"
_DOT_ANY = re.compile(_DOT, re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_SPELLED_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)

Span = tuple[int, int, str]


class Rewrite:
    """A text and where its stretches came from: parallel starts in the output and the source."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """``edits`` are disjoint, ordered ``(start, end, replacement)`` of the source."""
        parts, self.out, self.src, self.changed = [], [], [], []
        at = length = 0
        for start, end, new in edits:
            for piece, begin, changed in ((source[at:start], at, False), (new, start, True)):
                parts.append(piece)
                self.out.append(length)
                self.src.append(begin)
                self.changed.append(changed)
                length += len(piece)
            at = end
        parts.append(source[at:])
        self.out.append(length)
        self.src.append(at)
        self.changed.append(False)
        self.text = "".join(parts)
        self.size = len(source)

    def _run(self, position: int) -> int:
        return bisect_right(self.out, position) - 1

    def start(self, position: int) -> int:
        """Source position where the output character at ``position`` starts."""
        run = self._run(position)
        return self.src[run] if self.changed[run] else self.src[run] + position - self.out[run]

    def end(self, position: int) -> int:
        """Source position just after the output character before ``position``."""
        run = self._run(position - 1)
        if not self.changed[run]:
            return self.src[run] + position - self.out[run]
        return self.src[run + 1]

    def touches(self, start: int, end: int) -> bool:
        """Whether the output stretch holds or spans a rewritten place."""
        first, last = self._run(start), self._run(end - 1)
        return any(self.changed[first : last + 1])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
            at = text.find("@", floor)
        else:
            # What stands before this sign cannot be part of a later local part.
            floor, at = at + 1, text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + (i & 1))
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` of the identifiers written plainly, by start, then kind as listed."""
    found = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _disguised_emails(text: str) -> list[tuple[int, int, str]]:
    """Edits that write disguised at and dot signs of addresses plainly.

    A bare "at" counts only where the host spells a dot too; otherwise ordinary sentences would become addresses.
    """
    edits, floor = [], 0
    for sign in _AT.finditer(text):
        start = sign.start()
        if start < floor:
            continue
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, sign.end()) if start < sign.start() else None
        if not host:
            continue
        dots = [d for d in _DOT_ANY.finditer(text, host.start(), host.end()) if d[0] != "."]
        bare = sign[0].strip().lower() == "at"
        if bare and not dots or sign[0] == "@" and not dots:
            continue
        if sign[0] != "@":
            edits.append((sign.start(), sign.end(), "@"))
        edits += [(d.start(), d.end(), ".") for d in dots]
        floor = host.end()
    return edits


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED_RUN.finditer(text):
        digits = "".join(SPELLED.get(d[0].lower(), d[0]) for d in _SPELLED_ONE.finditer(m[0]))
        edits.append((m.start(), m.end(), digits))
    return edits


def _spelled_ips(text: str) -> list[tuple[int, int, str]]:
    hits = [m for m in _SPELLED_IP.finditer(text) if "dot" in m[0].lower()]
    return [(d.start(), d.end(), ".") for m in hits for d in _DOT_ANY.finditer(text, m.start(), m.end()) if d[0] != "."]


_TWO_SPELLED = re.compile(rf"(?:{_NUMBER})[\x20-]{{1,2}}(?:{_NUMBER}|[0-9])")
# What a text with a disguised at or dot sign holds, lower-cased.
_SIGN_WORDS = tuple(f"{b}{gap}at" for b in "[({<" for gap in ("", " ")) + (" dot ",) + tuple(f"{b}{gap}dot" for b in "[({<" for gap in ("", " "))


def _steps_for(text: str) -> list:
    """The transducers that could change this text, by cheap tests."""
    low = text.lower()
    folds = not text.isascii() and _FOLDED.search(text) is not None
    steps = [_fold_edits] if folds else []
    if folds or _TWO_SPELLED.search(low):
        steps.append(_spelled_edits)
    if folds or any(w in low for w in _SIGN_WORDS):
        steps += [_disguised_emails, _spelled_ips]
    return steps


def _fold_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), FOLD[m[0]]) for m in _FOLDED.finditer(text)]


def disguised_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` in the source of identifiers that only normalising reveals."""
    steps, now = [], text
    for edits_of in _steps_for(text):
        edits = edits_of(now)
        if edits:
            steps.append(Rewrite(now, edits))
            now = steps[-1].text
    if not steps:
        return []
    found = []
    for start, end, kind in plain_spans(now):
        touched = False
        for step in reversed(steps):
            touched = touched or step.touches(start, end)
            start, end = step.start(start), step.end(end)
        if touched:
            found.append((start, end, kind))
    return found


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans: the plain ones and the disguised ones that no plain span of their kind covers."""
    plain = plain_spans(text)
    more = [s for s in disguised_spans(text) if not any(p[2] == s[2] and p[0] <= s[0] and s[1] <= p[1] for p in plain)]
    return plain, sorted({*plain, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str) -> str:
    """The text with every found stretch replaced by its kind in angle brackets; overlapping spans as one stretch."""
    out, at, open_end, kind = [], 0, -1, ""
    merged: list[list] = []
    for start, end, kind in spans(text)[1]:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, open_end, kind in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = open_end
    return "".join([*out, text[at:]])


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text in frame["text"]:
            plain, every = spans(text)
            counts = [sum(s[2] == k for s in plain) for k in KINDS]
            rows.append((*counts, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(every), len(every) - len(plain)))
        out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
        out.insert(0, "doc_id", frame["doc_id"].to_numpy())
        yield out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of plain spans by kind, their digest, all spans, and how many were disguised.

    Null text is empty: counts 0, the digest of the empty string, no spans. Repeated rows come out repeated.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInPandas(
        _find,
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint",
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers masked in ``text`` and ``n_chars`` recounted; null text stays null."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t))

    masked = docs.withColumn("text", mask(F.col("text").cast("string")))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked
