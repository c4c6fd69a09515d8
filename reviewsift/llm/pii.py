"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is. Then transducers rewrite it: look-alike characters become
ASCII (one for one), invisible ones go, ``at`` and ``dot`` disguises become ``@`` and ``.``, spelled digits
become digits. Every rewritten character keeps the span it came from, so identifiers found in
the rewritten text are given as spans of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.llm.common import EMPTY_SHA256, per_value

KINDS = ("email", "ip", "card", "phone")

# Detectors. The lookbehinds and possessive runs change no match; they keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping ``local@domain.domain``, found from their ``@``."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of base identifiers, by kind, then start."""
    found = [("email", *s) for s in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


# Letters of other scripts that look like the ASCII letters below them.
_LOOKALIKES = str.maketrans(
    "аеіјорсухѕһԁԛԝᴠАВЕЅІЈКМНОРСТУХѴΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνιαɡ․。．＠﹫",
    "aeijopcyxshdqwvABESIJKMHOPCTYXVABEZHIKMNOPTYXopviag...@@")
#: Zero-width characters, soft hyphen, byte order mark.
INVISIBLE = "­​‌‍⁠﻿"


class _Lookalikes(dict):
    """One ASCII character for a code point: listed look-alikes, full-width forms, digits of any script."""

    def __missing__(self, code: int) -> int:
        found = _LOOKALIKES.get(code, code)
        if 0xFF01 <= code <= 0xFF5E:
            found = code - 0xFEE0
        elif code > 0x7F and unicodedata.category(chr(code)) == "Nd":
            found = 0x30 + unicodedata.decimal(chr(code))
        self[code] = found
        return found


_ASCII_LIKE = _Lookalikes()

#: Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
          "seven": "7", "eight": "8", "nine": "9"}
_SPELLED = "|".join(DIGITS)
# Last labels that make words around a bare "at" an address.
_LAST = "com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|co|me|tv|eu|uk|us|de|fr|es|it|nl|be|ch|at|pl|se|no|dk|fi|pt|ru|in|jp|cn|br|mx|ca|au"
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
#: One alternative per disguise. Bare "at" and "dot" count only in a whole spoken address; spelled digits only in
#: runs of seven or more.
_DISGUISE = re.compile(
    rf"(?P<hidden>[{INVISIBLE}]+)"
    rf"|(?P<at>{_OPEN}(?:at|@){_CLOSE})|(?P<dot>{_OPEN}(?:dot|\.){_CLOSE})"
    r"|(?<![A-Za-z0-9._%+-])(?P<address>[A-Za-z0-9._%+-]{1,64}(?:\s{1,3}dot\s{1,3}[A-Za-z0-9_%+-]{1,64}){0,3}"
    rf"\s{{1,3}}at\s{{1,3}}[A-Za-z0-9-]{{1,63}}(?:\s{{1,3}}dot\s{{1,3}}[A-Za-z0-9-]{{1,63}}){{0,7}}\s{{1,3}}dot\s{{1,3}}(?:{_LAST}))(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z])(?P<digits>(?:plus[ ,.-]{{1,3}})?(?:{_SPELLED})(?:[ ,.-]{{1,3}}(?:{_SPELLED}|dot|point)){{6,}})(?![A-Za-z])",
    re.IGNORECASE)
_SPOKEN = re.compile(r"\s+(at|dot)\s+", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+", re.IGNORECASE)
#: What a text must have for a rewriting to change what is found in it.
_TRIGGER = re.compile(
    rf"[{INVISIBLE}]|[\[({{<]\s{{0,3}}(?:at|@|dot|\.)\s{{0,3}}[\])}}>]|\sdot\s|(?:{_SPELLED})[ ,.-]{{1,3}}(?:{_SPELLED})(?![a-z])",
    re.IGNORECASE)


class Rewritten:
    """A rewritten text whose every stretch knows the stretch of the source it came from."""

    def __init__(self, source: str):
        self.parts: list[str] = []
        self.at: list[int] = []  # where a part starts in the rewritten text
        self.spans: list[tuple[int, int, bool]] = []  # its source; whether it is copied
        self.size = 0
        done = 0
        for m in _DISGUISE.finditer(source):
            self._copy(source, done, m.start())
            done = m.end()
            kind = m.lastgroup
            if kind in ("at", "dot"):
                self._put("@" if kind == "at" else ".", m.start(), m.end())
            elif kind == "address":
                at = m.start()
                for s in _SPOKEN.finditer(source, m.start(), m.end()):
                    self._copy(source, at, s.start())
                    self._put("@" if s[1].lower() == "at" else ".", s.start(), s.end())
                    at = s.end()
                self._copy(source, at, m.end())
            elif kind == "digits":
                for w in _WORD.finditer(source, m.start(), m.end()):
                    word = w[0].lower()
                    self._put(DIGITS.get(word, "+" if word == "plus" else "."), w.start(), w.end())
        self._copy(source, done, len(source))
        self.text = "".join(self.parts)

    def _copy(self, source: str, start: int, end: int) -> None:
        if start < end:
            self._add(source[start:end], start, end, True)

    def _put(self, text: str, start: int, end: int) -> None:
        self._add(text, start, end, False)

    def _add(self, text: str, start: int, end: int, copied: bool) -> None:
        self.parts.append(text)
        self.at.append(self.size)
        self.spans.append((start, end, copied))
        self.size += len(text)

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        """The source of the rewritten characters from ``start`` to ``end``."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first, last = self.spans[i], self.spans[j]
        return (first[0] + start - self.at[i] if first[2] else first[0],
                last[0] + end - self.at[j] if last[2] else last[1])


def find_all(text: str | None) -> list[dict]:
    """Base identifiers, and those found in the rewritten text that overlap none of their kind."""
    text = text or ""
    base = find(text)
    out = [{"kind": k, "start": s, "end": e, "base": True} for k, s, e in base]
    plain = text if text.isascii() else text.translate(_ASCII_LIKE)
    rewrite = _TRIGGER.search(plain) is not None
    if plain == text and not rewrite:
        return out
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    new = Rewritten(plain) if rewrite else None
    for kind, s, e in find(new.text if new else plain):
        if new:
            s, e = new.source_span(s, e)
        spans = taken[kind]  # by start, disjoint
        i = bisect_right(spans, (s, len(text) + 1))
        if not (i and spans[i - 1][1] > s) and not (i < len(spans) and spans[i][0] < e):
            out.append({"kind": kind, "start": s, "end": e, "base": False})
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda r: (order[r["kind"]], r["start"], r["end"]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def personal_data(text: Column) -> Column:
    """Array of (kind, start, end, base) of whole texts: code points, end exclusive, by kind, then start."""

    @F.arrow_udf("array<struct<kind string, start long, end long, base boolean>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return per_value(batches, SPANS, lambda texts: [find_all(t) for t in texts])

    return found(text)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` for every row of ``docs``; null and empty texts have an empty array.

    Each row is scanned by itself, so equal rows, ties and null ids need no care. Other columns are not read.
    """
    return docs.select(F.col(id_col).alias("id"), personal_data(F.col(text_col)).alias("spans"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    listed = span_list(spans)
    return F.when(listed == "", F.lit(EMPTY_SHA256)).otherwise(F.sha2(listed, 256))
