"""License scans: ordered signature rules behind a keyword gate, with priority and containment resolving overlaps.

A rule is a label, a priority, a keyword and a regular expression over lowered text in which runs of anything but word
characters are one space. An Aho-Corasick automaton of all keywords runs over each text once; a rule's expression is tried
only where its keyword occurs. Detections are taken by priority, then length, then place; one that lies within a taken one,
or overlaps one of a higher priority, is suppressed.

The base detections (word phrases with a fixed label) are always kept, whatever the rules say.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import documents, out_schema, pieces
from citygeo.llm.license_rules import RULES

# Phrases that count as base detections, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_TABLE = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _compile(rules: list[tuple[str, int, str, str]]) -> tuple[ahocorasick.Automaton, list[tuple[str, int, re.Pattern]]]:
    gate, by_key = ahocorasick.Automaton(), {}
    for i, (_, _, key, _) in enumerate(rules):
        by_key.setdefault(key, []).append(i)
    for key, own in by_key.items():
        gate.add_word(key, own)
    gate.make_automaton()
    return gate, [(label, priority, re.compile(rf"(?<![^ ]){pattern}(?![^ ])")) for label, priority, _, pattern in rules]


def detections(text: str, gate: ahocorasick.Automaton, rules: list[tuple[str, int, re.Pattern]]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) over plain text, overlaps resolved, in order of place."""
    tried = {i for _, own in gate.iter(text) for i in own}
    found = [(m.start(), m.end(), rules[i][0], rules[i][1]) for i in sorted(tried) for m in rules[i][2].finditer(text)]
    return resolve(found)


def resolve(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections that stay, in order of place. Priorities take turns from the highest: a detection that overlaps one taken in an
    earlier turn goes; of the others, from left to right and longest first, one that ends by the furthest end so far goes."""
    taken: list[tuple[int, int, str, int]] = []
    for priority in sorted({hit[3] for hit in found}, reverse=True):
        starts, ends, reach = [], [], -1  # stretches that earlier turns cover
        for s, e, _, _ in sorted(taken):
            if s >= reach:
                starts.append(s)
                ends.append(e)
            reach = ends[-1] = max(reach, e)
        reach = -1
        for hit in sorted((h for h in found if h[3] == priority), key=lambda h: (h[0], -h[1], h[2])):
            k = bisect_left(starts, hit[1])  # the last stretch that begins before the end
            if hit[1] <= reach or (k and ends[k - 1] > hit[0]):
                continue
            reach = hit[1]
            taken.append(hit)
    return sorted(taken)


def _places(words: list[bytes], joined: bytes) -> list[tuple[int, str]]:
    """Word positions of base phrases."""
    out = []
    for phrase, label in BASE.items():
        key = phrase.encode()
        if key in joined:
            parts, at = key.split(), -1
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(parts)] == parts:
                    out.append((at, label))
    return sorted(out)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, int, str, str]] | None = None) -> DataFrame:
    """Per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score and found.

    found has the rules' detections as (label, start_word, end_word, priority). labels joins base and rules' labels. score is
    the best priority over 100, 1 for a base detection, 0 for none. Null and empty texts have no words, null places and empty
    labels. Ids may be null or repeat; other columns are not read.
    """
    rules = RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, compiled = _compile(rules)
        for piece in pieces(batches):
            rows = []
            for text in piece.column(1).to_pylist():
                words = (text or "").encode().translate(_TABLE).split()
                joined = b" ".join(words)
                places = _places(words, joined)
                plain = joined.decode()
                hits = detections(plain, gate, compiled)
                base = sorted({label for _, label in places})
                labels = sorted({*base, *(h[2] for h in hits)})
                blanks = [m.start() for m in re.finditer(" ", plain)] if hits else []
                found = [{"label": x, "start_word": bisect_left(blanks, s), "end_word": bisect_left(blanks, e) + 1, "priority": p} for s, e, x, p in hits]
                score = 1.0 if base else max((h[3] for h in hits), default=0) / 100
                rows.append((len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(labels), score, found))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, zip(*rows), kinds)], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label: string, start_word: long, end_word: long, priority: int>>"
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, out_schema(docs, id_col, fields))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
