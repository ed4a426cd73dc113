r"""Offset-preserving detection of personal data, in plain and in disguised spelling.

Plain identifiers are found in the text as it stands. For the disguised ones, a transducer rewrites the text
and keeps, for every character it writes, the source characters it stands for: look-alike letters, compatible forms (mathematical, circled, full-width)
and digits of other scripts become ASCII, zero-width characters go, ``(at)``/``[dot]`` and the bare words between the parts of an address become
``@`` and ``.``, runs of spelled digits become digits. Identifiers found in the rewritten text that rest on at
least one rewritten or deleted character are mapped back to source positions and added; plain ones always stay.

Work is linear in the text's length: the patterns are anchored so that no run of characters is scanned from each of its positions.

Defined results: a null or empty text has no spans. Positions are code points, ends exclusive. Spans are sorted by start,
then kind in the order of KINDS. Added spans wholly inside one plain span of their kind are left out, others stay beside it. Repeated rows get equal results, an empty table none; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters and marks that look like ASCII ones without being forms of them.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХԚԜаеорсухіјѕһԁԍԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαεικρυνɡɑıɩⲟօոս·․•‧∙⋅。｡‐‑‒–−",
    "ABESIJKMHOPCTYXQWaeopcyxijshdgqwlABEZHIKMNOPTYXoaeikpuvgaiioonu........-----",
    strict=True,
))


def forms() -> dict[str, str]:
    """Characters that Unicode calls compatible forms of one ASCII letter, digit or mark of an identifier (mathematical, circled, raised, full-width),
    and the decimal digits of all scripts."""
    out = {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        if unicodedata.category(c) == "Nd":
            out[c] = str(unicodedata.digit(c))
        elif unicodedata.decomposition(c).startswith("<"):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and (plain in LOCAL or plain in "@()"):
                out[c] = plain
    return out


# Digit words of the four languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
ZERO_WIDTH = "​‌‍⁠﻿­"
#: What every such character is rewritten to; zero-width ones to nothing.
ONE_TO_ONE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | forms() | LOOKALIKES | dict.fromkeys(ZERO_WIDTH, "")
OTHER = frozenset(ONE_TO_ONE)
NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_AT, _DOT = r"(?:at|arobase|arroba|ät)", r"(?:dot|punkt|point|punto)"
# Endings that a fully spelled-out address must have, as any words may stand around "at" and "dot".
_TOP = "com|org|net|edu|gov|info|biz|io|ai|app|dev|eu|uk|us|ca|au|nz|ie|in|de|at|ch|fr|be|nl|es|mx|ar|it|pt|br|pl|se|no|fi|dk|cz|ru|jp|cn|test|example|invalid"
_SPELLED = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
BRACKETED_AT = rf"[ ]?[\[({{<][ ]?(?:{_AT}|@)[ ]?[\])}}>][ ]?"
BRACKETED_DOT = rf"[ ]?[\[({{<][ ]?(?:{_DOT}|\.)[ ]?[\])}}>][ ]?"
#: word at word dot word, all spelled out
SPELLED_ADDRESS = re.compile(rf"(?<![\w.%+-])[a-z0-9][a-z0-9._%+-]{{0,63}}(?P<at> {_AT} )[a-z0-9-]{{1,63}}(?:(?: {_DOT} |\.)[a-z0-9-]{{1,63}})*? {_DOT} (?:{_TOP})(?!\w)", re.IGNORECASE)
BRACKETS = re.compile(rf"(?P<at>{BRACKETED_AT})|(?P<dot>{BRACKETED_DOT})", re.IGNORECASE)
#: An address whose at is plain or bracketed, with spelled dots behind it.
DOTS_BEHIND = re.compile(rf"@[a-z0-9-]{{1,63}}(?:(?: {_DOT} |\.)[a-z0-9-]{{1,63}})*? {_DOT} (?:{_TOP})(?!\w)", re.IGNORECASE)
#: At least four parts in a row, digit words with dots or digits between, a spelled plus in front. A run is taken whole, so none is scanned twice.
SPELLED_DIGITS = re.compile(rf"(?<!\w)(?:plus[ -])?(?:(?:{_SPELLED})(?!\w)[ ,-]{{0,2}}|(?:{_DOT}|\.)[ ]|[0-9]+(?!\w)[ -]?){{4,}}+", re.IGNORECASE)
SPELLED_PART = re.compile(rf"(?P<plus>plus[ -])|(?P<word>{_SPELLED})(?!\w)|(?P<dot>{_DOT}(?!\w)|\.)|(?P<digits>[0-9]+)", re.IGNORECASE)
SPACED_WORD = re.compile(rf"(?: {_DOT} )", re.IGNORECASE)


def _digits(s: str) -> str:
    return s.translate(_DROP) if len(s) < 200 else ""


_DROP = str.maketrans("", "", " ().-+")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


FINDERS = (emails, ips, cards, phones)
Span = tuple[int, int, int]  # start, kind, end


def find_plain(text: str) -> list[Span]:
    return sorted((a, kind, b) for kind, find in enumerate(FINDERS) for a, b in find(text))


class Rewritten:
    """A rewritten text and, piece by piece, the source characters of what was written."""

    def __init__(self, source: str) -> None:
        self.text = source
        self.at, self.start, self.end, self.changed = [0], [0], [len(source)], [False]

    def source_span(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        first = self.start[i] if self.changed[i] else self.start[i] + a - self.at[i]
        last = self.end[j] if self.changed[j] else self.start[j] + b - self.at[j]
        return first, last

    def touched(self, a: int, b: int) -> bool:
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1)
        if any(self.changed[i:j]):
            return True
        first, last = self.source_span(a, b)
        return last - first > b - a  # unchanged pieces with deletions between

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Applies sorted, disjoint ``(start, end, new)`` edits of the present text."""
        if not edits:
            return
        out, at, start, end, changed, done, length = [], [], [], [], [], 0, 0

        def piece(text: str, a: int, b: int, is_changed: bool) -> None:
            nonlocal length
            if text:
                at.append(length)
                start.append(a)
                end.append(b)
                changed.append(is_changed)
                out.append(text)
                length += len(text)

        def keep(a: int, b: int) -> None:
            i = bisect_right(self.at, a) - 1
            while a < b:
                upto = min(b, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                if self.changed[i]:
                    piece(self.text[a:upto], self.start[i], self.end[i], True)
                else:
                    s = self.start[i] + a - self.at[i]
                    piece(self.text[a:upto], s, s + upto - a, False)
                a, i = upto, i + 1

        for a, b, new in edits:
            keep(done, a)
            s, e = self.source_span(a, b)
            piece(new, s, e, True)
            done = b
        keep(done, len(self.text))
        self.text, self.at, self.start, self.end, self.changed = "".join(out), at or [0], start or [0], end or [0], changed or [False]


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """One edit for a run of spelled digits, up to its last digit: digits and dots, a plus in front."""
    parts = list(SPELLED_PART.finditer(m[0]))
    while parts and parts[-1]["dot"]:
        parts.pop()
    if sum(1 for p in parts if p["word"]) < 4:
        return []
    new = ["+" if p["plus"] else "." if p["dot"] else p["digits"] or DIGIT_WORDS[p["word"].lower()] for p in parts]
    return [(m.start(), m.start() + parts[-1].end(), "".join(new))]


def rewrite(text: str) -> Rewritten:
    r = Rewritten(text)
    if not OTHER.isdisjoint(text):
        r.replace([(m.start(), m.end(), ONE_TO_ONE[m[0]]) for m in NOT_ASCII.finditer(text) if m[0] in OTHER])
    if any(c in r.text for c in "[({<"):
        r.replace([(m.start(), m.end(), "@" if m["at"] else ".") for m in BRACKETS.finditer(r.text)])
    low = r.text.lower()
    if any(w in low for w in (" dot ", " punkt ", " point ", " punto ")):
        edits = []
        for m in SPELLED_ADDRESS.finditer(r.text):
            edits.append((*m.span("at"), "@"))
            edits += [(d.start(), d.end(), ".") for d in SPACED_WORD.finditer(r.text, m.end("at") - 1, m.end())]
        r.replace([(a, b, new) for i, (a, b, new) in enumerate(edits) if i == 0 or a >= edits[i - 1][1]])
        r.replace([(d.start(), d.end(), ".") for m in DOTS_BEHIND.finditer(r.text) for d in SPACED_WORD.finditer(r.text, m.start(), m.end())])
    r.replace([e for m in SPELLED_DIGITS.finditer(r.text) for e in _spelled(m)])
    return r


def find_disguised(text: str, plain: list[Span]) -> list[Span]:
    r = rewrite(text)
    if r.text == text:
        return []
    out = []
    for kind, find in enumerate(FINDERS):
        same = [p for p in plain if p[1] == kind]  # disjoint, in order
        starts = [p[0] for p in same]
        for a, b in find(r.text):
            if r.touched(a, b):
                s, e = r.source_span(a, b)
                i = bisect_right(starts, s) - 1
                if i < 0 or same[i][2] < e:
                    out.append((s, kind, e))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULTS = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the counts of plain spans by kind, ``n_added`` disguised ones, the
    digest of the plain spans and all spans as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf[text]:
                t = t or ""
                plain = find_plain(t)
                added = find_disguised(t, plain)
                counts = [sum(1 for s in plain if s[1] == k) for k in range(len(KINDS))]
                rows.append((*counts, len(added), hashlib.sha256(joined(plain).encode()).hexdigest(), joined(sorted(plain + added))))
            found = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULTS.split(", ")], index=pdf.index)
            yield pd.concat([pdf[list(keep)], found], axis=1)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInPandas(run, f"{kinds}, {RESULTS}")
