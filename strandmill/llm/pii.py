"""Personal data in texts, with disguises undone and offsets kept.

Three transducers run one after another over a text: homoglyphs to ASCII,
spelled digits to digits, at/dot disguises to signs. Each yields the rewritten
text and, for each of its characters, the source span that it stands for, so
that an identifier found in the normal form maps back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A quad can only start where a run of digits starts: from within the run it would fail or succeed alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, index in KINDS, end) of the plain patterns, in order of start, then kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _confusables() -> dict[str, str]:
    out = {}
    pairs = (
        ("АВСЕНІЈКМОРЅТУХЗаеорсухіјѕһԁԛԝӏгѵ", "ABCEHIJKMOPSTYX3aeopcyxijshdqwlrv"),
        ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορτυχικ", "ABEZHIKMNOPTYXavoptuxik"),
        ("‐‑‒–—−﹣－", "--------"),
        ("․。｡．", "...."),
        ("      　", "       "),
    )
    for a, b in pairs:
        out |= dict(zip(a, b, strict=True))
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x249C), *range(0x2070, 0x208A), *range(0x24B6, 0x24EA), 0xFE6B, 0xFE52, 0xFE62):
        to = unicodedata.normalize("NFKC", c := chr(code))
        if len(to) == 1 and to.isascii():
            out.setdefault(c, to)
    for first in (0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xF20):
        out |= {chr(first + i): str(i) for i in range(10)}
    return out | dict.fromkeys("­​‌‍⁠﻿", "")


CONFUSABLE = _confusables()
_CONFUSABLE = re.compile("[" + "".join(map(re.escape, sorted(CONFUSABLE))) + "]")

_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
SPELLED = {w: str(i) for line in _WORDS for i, w in enumerate(line.split())} | {"oh": "0", "nought": "0", "zwo": "2"}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: At least three digits in a row of which one or more are words.
_SPELLED_RUN = re.compile(rf"\b(?:{_WORD})\b(?:[ .,()-]{{1,3}}(?:{_WORD}|[0-9]+)\b){{2,}}|\b[0-9]+(?:[ .,()-]{{1,3}}(?:{_WORD}|[0-9]+)\b)*?[ .,()-]{{1,3}}{_WORD}\b(?:[ .,()-]{{1,3}}(?:{_WORD}|[0-9]+)\b)+", re.I)
_ONE = re.compile(rf"\b{_WORD}\b", re.I)
_PLUS = re.compile(r"\bplus\s+(?=[0-9])", re.I)
_MIXED_HINT = re.compile(r"[0-9][OolI][ -]?[0-9]")
_MIXED = re.compile(r"(?<=[0-9])[OolI](?=[ -]?[0-9])")

_DOT_WORD = "(?:dot|punkt|point|punto)"
_BRACKET = r"[(\[{<]\s*(?:%s)\s*[)\]}>]"
_AT_IN = r"\s*" + _BRACKET % "at|arroba|@|ät" + r"\s*"
_DOT_IN = r"\s*" + _BRACKET % r"dot|punkt|point|punto|\." + r"\s*"
#: A bare word counts only before a domain with a disguised dot: "at example.com" alone is plain prose.
_BARE_AT = rf"(?<=[A-Za-z0-9_%+-])\s+(?:at|arroba)\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\s+{_DOT_WORD}\s+|{_DOT_IN})[A-Za-z0-9-]+)"
_AT = re.compile(rf"{_AT_IN}|{_BARE_AT}", re.I)
_BARE_DOT = rf"(?<=[A-Za-z0-9])\s+{_DOT_WORD}\s+(?=[A-Za-z0-9])"
_DOT = re.compile(rf"{_DOT_IN}|{_BARE_DOT}", re.I)
_DISGUISE = re.compile(r"[(\[{<]\s*(?:at|arroba|ät|@|dot|punkt|point|punto|\.)\s*[)\]}>]|\s(?:dot|punkt|punto|point)\s", re.I)


class Mapped:
    """A rewritten text and the source span of each of its characters."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], str]) -> Mapped:
        """Each match becomes ``by(match)``; all its characters stand for the whole match."""
        parts: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        done = 0
        for m in pattern.finditer(self.text):
            to = by(m)
            if to == m[0] or m.end() == m.start():
                continue
            parts += (self.text[done : m.start()], to)
            starts += self.starts[done : m.start()]
            ends += self.ends[done : m.start()]
            starts += [self.starts[m.start()]] * len(to)
            ends += [self.ends[m.end() - 1]] * len(to)
            done = m.end()
        if not done:
            return self
        starts += self.starts[done:]
        ends += self.ends[done:]
        return Mapped("".join([*parts, self.text[done:]]), starts, ends)

    def rewrite_within(self, outer: re.Pattern, inner: re.Pattern, by: Callable[[re.Match], str]) -> Mapped:
        """As ``rewrite`` by ``inner``, but only inside the matches of ``outer``."""
        spots = [m.span() for m in outer.finditer(self.text)]
        if not spots:
            return self
        inside = [(a + m.start(), a + m.end()) for a, b in spots for m in inner.finditer(self.text[a:b])]
        wanted = dict(inside)
        return self.rewrite(inner, lambda m: by(m) if wanted.get(m.start()) == m.end() else m[0])


def _latin(text: str) -> bool:
    """Whether nothing in the text can be confusable; far cheaper than the pattern."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "\xa0" not in text and "\xad" not in text


def homoglyphs(t: Mapped) -> Mapped:
    return t if t.text.isascii() or _latin(t.text) or not _CONFUSABLE.search(t.text) else t.rewrite(_CONFUSABLE, lambda m: CONFUSABLE[m[0]])


def _may_be_spelled(lower: str) -> bool:
    """Whether a digit's name stands beside another or beside a number; cheaper than the pattern."""
    for c in ".,()-":
        lower = lower.replace(c, " ")
    words = lower.split()
    near = [i for i, w in enumerate(words) if w in SPELLED]
    return any((i and (words[i - 1] in SPELLED or words[i - 1].isdigit())) or (i + 1 < len(words) and words[i + 1].isdigit()) for i in near)


def spelled_digits(t: Mapped) -> Mapped:
    lower = t.text.lower()
    if _may_be_spelled(lower):
        t = t.rewrite_within(_SPELLED_RUN, _ONE, lambda m: SPELLED[m[0].lower()])
    if _MIXED_HINT.search(t.text):
        t = t.rewrite(_MIXED, lambda m: "0" if m[0] in "Oo" else "1")
    if "plus" in lower:
        t = t.rewrite(_PLUS, lambda _: "+")
    return t


def signs(t: Mapped) -> Mapped:
    lower = t.text.lower()
    if not any(w in lower for w in ("dot", "punkt", "point", "punto", "at)", "at]", "at}", "at>", "@)", "@]", "arroba", "at ", "ät")) or not _DISGUISE.search(t.text):
        return t
    t = t.rewrite(_AT, lambda _: "@")
    # Bare words for a dot count in the names on either side of an at sign, or between digits.
    spots = re.compile(rf"@[A-Za-z0-9-]+(?:(?:\.|\s+{_DOT_WORD}\s+|{_DOT_IN})[A-Za-z0-9-]+)+|[0-9]+(?:(?:\.|\s+{_DOT_WORD}\s+|{_DOT_IN})[0-9]+){{3}}|(?<![A-Za-z0-9.])[A-Za-z0-9]++(?:(?:\.|\s+(?:dot|punkt|punto)\s+|{_DOT_IN})[A-Za-z0-9]++)++(?=@)", re.I)
    return t.rewrite_within(spots, _DOT, lambda _: ".")


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and those that only the normal form shows, both in source characters."""
    base = base_spans(text)
    normal = signs(spelled_digits(homoglyphs(Mapped.of(text))))
    if normal.text == text:
        return base, []
    have, added = set(base), set()
    for s, kind, e in base_spans(normal.text):
        span = (normal.starts[s], kind, normal.ends[e - 1])
        if span not in have and text[span[0] : span[2]] != normal.text[s:e]:
            added.add(span)
    return base, sorted(added)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts and digest of the base spans, and all spans as text.

    A null text counts as empty. Offsets are code points, ends exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column(1):
                base, added = find(cell.as_py() or "")
                n = [0] * 4
                for _, k, _ in base:
                    n[k] += 1
                out.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted({*base, *added})), len(added)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            names = [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=names)

    schema = f"{key} long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_disguised long"
    return map_in_arrow(_texts(docs, key, text), run, schema)


def identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span: ``key, kind, start, end, value`` (source characters) and whether it was disguised.

    Null and empty texts have none; repeated rows give repeated spans; texts are
    read whole; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = cell.as_py() or ""
                base, added = find(source)
                rows += [(doc, KINDS[k], s, e, source[s:e], hid) for spans, hid in ((base, False), (added, True)) for s, k, e in spans]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            names = [key, "kind", "start", "end", "value", "disguised"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return map_in_arrow(_texts(docs, key, text), run, f"{key} long, kind string, start long, end long, value string, disguised boolean")
