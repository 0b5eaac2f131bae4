"""Personal data by offset-preserving deobfuscation.

A tape is a text in which every sign knows the source characters it stands for. Three transducers rewrite the tape in turn:
lookalike letters, digits of other scripts and invisible signs; spelled digits; disguised at and dot. The detectors that read
the source then read the tape, and what they find across rewritten signs is mapped back to source characters. Spans found in
the source itself (the base) stay as they are.

All detectors take linear time: none retries inside a run of signs that has failed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import documents, out_schema, pieces

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """From each @ outwards: a local part that reaches back at most to the last match, and a domain with a dot."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", at + 1)
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def detect(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, leftmost first, none overlapping another of its kind. Failing matches are dropped."""
    out: dict[str, list[Span]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# Lookalikes of ASCII signs in other scripts. Full-width and mathematical forms follow from their names.
_LOOKALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧονıℓ․‧∙·＠﹫。｡．﹒‐‑‒–—−﹣－＋﹢",
    "ABESIJKMHOPCTYXaesijopcyxhdqwgABEZHIKMNOPTYXovil....@@....--------++",
)
_INVISIBLE = "­​‌‍⁠﻿"
_FORMS = "[٠-٩۰-۹०-९０-ｚ\U0001d400-\U0001d7ff①-⑨]"
_ODD = re.compile(f"[{''.join(map(chr, _LOOKALIKES))}{_INVISIBLE}]|{_FORMS}")
# Names of the digits 0 to 9.
_NAMES = ["zero null zéro cero oh", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"]
_VALUE = {name: str(d) for d, names in enumerate(_NAMES) for name in names.split()}
_NAME = "|".join(sorted(_VALUE, key=len, reverse=True))
_POINT_WORD = r"(?:dot|point|punkt|punto)"
_BETWEEN = rf"(?:[ \t]+{_POINT_WORD}[ \t]+|[ \t,-]+)"
_SPELLED = re.compile(rf"(?<!\w)(?:{_NAME}|[0-9]+)(?:{_BETWEEN}(?:{_NAME}|[0-9]+))+(?!\w)")
_ITEM = re.compile(rf"(?<!\w)(?:{_NAME}|[0-9]+)(?!\w)")
_SPELLED_GATE = re.compile(rf"(?<!\w)(?:{_NAME}){_BETWEEN}(?:{_NAME}|[0-9])")
_PLUS = re.compile(r"(?<!\w)plus[ \t]+(?=[0-9])")
_POINT = re.compile(rf"(?<=[0-9])(?:[ \t]*[(\[{{<][ \t]*(?:{_POINT_WORD}|\.)[ \t]*[)\]}}>][ \t]*|[ \t]+{_POINT_WORD}[ \t]+)(?=[0-9])")
_AT_WORD, _DOT_WORD = r"(?:at|arroba|ät)", _POINT_WORD
# Blanks are entered at their start alone, so a run of them is read once.
_AT = re.compile(rf"(?<![ \t])(?:[ \t]*+[(\[{{<][ \t]*(?:{_AT_WORD}|@)[ \t]*[)\]}}>][ \t]*+|[ \t]++{_AT_WORD}[ \t]++|[ \t]*+@[ \t]*+)")
_DOT = re.compile(rf"(?<![ \t])(?:[ \t]*+[(\[{{<][ \t]*(?:{_DOT_WORD}|\.)[ \t]*[)\]}}>][ \t]*+|[ \t]++{_DOT_WORD}[ \t]++)|\.")
_LABEL, _PART = re.compile(r"[A-Za-z0-9-]+"), re.compile(r"[A-Za-z0-9_%+-]+")
_DOT_GATE = re.compile(rf"[(\[{{<][ \t]*(?:{_AT_WORD}|{_DOT_WORD}|@|\.)[ \t]*[)\]}}>]|[ \t]{_DOT_WORD}[ \t]|[ \t]@|@[ \t]")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Tape:
    """text, and for each of its signs the source range and whether it was rewritten, as arrays."""

    def __init__(self, text: str):
        self.text, self.start = text, np.arange(len(text), dtype=np.int32)
        self.end, self.new = self.start + np.int32(1), np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges (ascending, apart); each sign of a replacement stands for the whole range. A range replaced by nothing
        marks its neighbours as rewritten."""
        if not edits:
            return
        n, parts, at = len(self.text), [], 0
        for a, b, text in edits:
            parts += [self.text[at:a], text]
            at = b
        begin, end = (np.array([e[k] for e in edits], np.int64) for k in (0, 1))
        size = np.array([len(e[2]) for e in edits], np.int64)
        beside = np.r_[begin[size == 0] - 1, end[size == 0]]
        self.new[beside[(beside >= 0) & (beside < n)]] = True
        gone = np.zeros(n + 1, np.int64)
        gone[begin] += 1
        gone[end] -= 1
        kept = np.flatnonzero(np.cumsum(gone[:n]) == 0)
        more = np.r_[0, np.cumsum(size)]
        place = np.arange(len(kept)) + more[np.searchsorted(end, kept, "right")]
        edit = np.repeat(np.arange(len(edits)), size)
        put = begin[edit] - np.r_[0, np.cumsum(end - begin)][edit] + np.arange(len(edit))  # kept signs before it, and signs put before it
        total = len(kept) + int(more[-1])

        def moved(own: np.ndarray, own_put: np.ndarray | bool) -> np.ndarray:
            out = np.empty(total, own.dtype)
            out[place], out[put] = own[kept], own_put
            return out

        self.text = "".join([*parts, self.text[at:]])
        self.start, self.end, self.new = moved(self.start, self.start[begin[edit]]), moved(self.end, self.end[end[edit] - 1]), moved(self.new, True)

    def source(self, span: Span) -> Span:
        return int(self.start[span[0]]), int(self.end[span[1] - 1])


def _plain(sign: str) -> str:
    if sign in _INVISIBLE:
        return ""
    if ord(sign) in _LOOKALIKES:
        return sign.translate(_LOOKALIKES)
    digit = unicodedata.digit(sign, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", sign)


def lookalikes(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), _plain(m.group())) for m in _ODD.finditer(tape.text)])


def spelled_digits(tape: Tape) -> None:
    """Runs of digit names, digits between them included, become digits without separators; plus before a digit becomes +."""
    low, edits = _lower(tape.text), []
    for run in _SPELLED.finditer(low):
        items = [m for m in _ITEM.finditer(low, run.start(), run.end())]
        if sum(m.group() in _VALUE for m in items) < 2:
            continue
        for k, m in enumerate(items):
            to = items[k + 1].start() if k + 1 < len(items) else m.end()
            value = _VALUE.get(m.group())
            if value is not None:
                edits.append((m.start(), m.end(), value))
            if to > m.end():
                edits.append((m.end(), to, "." if low[m.end() : to].strip(" \t,-") else ""))
    tape.rewrite(edits)
    tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(_lower(tape.text))])


def _address(low: str, at: re.Match, dots_by_end: Callable[[], dict[int, re.Match]]) -> list[tuple[int, int, str]]:
    """Edits that undo the disguise of an address around an at, or none if it is not one. dots_by_end: all dots of the text by where they end."""
    edits, disguised = [], False
    place = at.end()
    label = _LABEL.match(low, place)
    if not label or not at.start() or not _PART.match(low[at.start() - 1]):
        return []
    dots, place = 0, label.end()
    while (dot := _DOT.match(low, place)) and (label := _LABEL.match(low, dot.end())):
        if dot.group() != ".":
            edits.append((dot.start(), dot.end(), "."))
            disguised = True
        dots, place = dots + 1, label.end()
    sign = at.group().strip()
    if not dots or (sign[0] not in "([{<@" and not disguised) or (at.group() == "@" and not disguised):
        return []
    if at.group() != "@":
        edits.insert(0, (at.start(), at.end(), "@"))
    begin = at.start()
    while True:  # dots of the local part
        while begin and _PART.match(low[begin - 1]):
            begin -= 1
        back = dots_by_end().get(begin)
        if not back or not back.start() or not _PART.match(low[back.start() - 1]):
            return edits
        if back.group() != ".":
            edits.insert(0, (back.start(), back.end(), "."))
        begin = back.start()


def disguised_signs(tape: Tape) -> None:
    """Dots between digits, and at and dot in what is an address."""
    tape.rewrite([(m.start(), m.end(), ".") for m in _POINT.finditer(_lower(tape.text))])
    low, edits, done = _lower(tape.text), [], 0
    dots_by_end = cache(lambda: {m.end(): m for m in _DOT.finditer(low)})
    for at in _AT.finditer(low):
        found = [e for e in _address(low, at, dots_by_end) if e[0] >= done]
        edits += found
        done = max([done, *(e[1] for e in found)])
    tape.rewrite(edits)


TRANSDUCERS: list[tuple[Callable[[str], bool], Callable[[Tape], None]]] = [
    (lambda text: not text.isascii() and _ODD.search(text) is not None, lookalikes),
    (lambda text: _SPELLED_GATE.search(_lower(text)) is not None, spelled_digits),
    (lambda text: _DOT_GATE.search(_lower(text)) is not None, disguised_signs),
]


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans, of each kind."""
    text = text or ""
    base = detect(text)
    tape = None
    for needed, transduce in TRANSDUCERS:
        if needed(text if tape is None else tape.text):
            tape = tape or Tape(text)
            transduce(tape)
    if tape is None:
        return base, base
    every = {k: set(v) for k, v in base.items()}
    for kind, spans in detect(tape.text).items():
        every[kind] |= {tape.source(s) for s in spans if tape.new[s[0] : s[1]].any()}
    return base, {k: sorted(v) for k, v in every.items()}


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, base and spans, both array<struct<kind, start, end>> by kind as in KINDS, then start.

    Ranges are code points of the source text, ends exclusive. base is what the detectors find in the source; spans adds what they
    find on the tape across rewritten signs. Null and empty texts have no spans. Ids may be null or repeat; other columns are
    not read.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            both = [find(t) for t in piece.column(1).to_pylist()]
            listed = [[[{"kind": k, "start": a, "end": b} for k in KINDS for a, b in own[k]] for own in side] for side in zip(*both)]
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(side, pa.list_(item)) for side in listed)], [id_col, "base", "spans"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, out_schema(docs, id_col, f"base {kind}, spans {kind}"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
