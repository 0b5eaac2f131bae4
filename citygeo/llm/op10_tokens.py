"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

Counting cuts a text into pre-tokens, looks up each one's tokens (encoded once for each distinct pre-token of a task), and sums
them in a tree whose leaves are the pre-tokens. An edit is cut again from CONTEXT pre-tokens before it up to the first old
boundary behind it at which old and new text agree; as the pre-token pattern looks ahead only, all that follows is as it was.
The new count goes to the first leaf of the region, the others of it become zero, and the sums above are updated. A leaf's start
is always the start of a pre-token of the text as it is, so a tree takes one round of edits after the other.

Trees outlive a run: ``tree_table`` gives them as rows (id, text, lengths and counts of pre-tokens). A later run that is given such a
table counts only where a text differs from the one in it, and whatever edits touch. Any tree of a document will do, as it is
compared with the text first; a document without one is counted in full.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import documents, out_schema, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 3
MEMORY = 1 << 19
_PIECE = regex.compile(PATTERN)

Edit = tuple[int, int, str]


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of pre-tokens, each encoded once while it is remembered."""

    def __init__(self, path: str):
        self.encode, self.known = encoder(path).encode_ordinary, {}

    def __call__(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for part in parts:
            if part not in known:
                known[part] = len(self.encode(part))
        return list(map(known.__getitem__, parts))


class Tree:
    """Pre-token starts and a segment tree of their token counts: node i has children 2i and 2i + 1, leaves come last.

    ``known`` are lengths and counts of the text's pre-tokens, if they are; nothing is encoded then.
    """

    def __init__(self, text: str, count: Counter, known: tuple[np.ndarray, np.ndarray] | None = None):
        if known is None:
            parts = _PIECE.findall(text)
            known = np.fromiter(map(len, parts), np.int64, len(parts)), np.array(count(parts), np.int64)
        lengths, counts = known
        self.text, self.count, self.touched, self.n_parts = text, count, 0, len(lengths)
        self.fine: dict[int, list[tuple[int, int]]] = {}  # pre-tokens (length, count) of leaves that edits changed
        self.starts = np.r_[0, np.cumsum(lengths)].tolist()
        if not len(lengths):
            self.starts.append(0)  # one empty leaf
        self.width = max(1, 1 << (max(1, len(lengths)) - 1).bit_length())
        levels = [np.zeros(self.width, np.int64)]
        levels[0][: len(lengths)] = counts
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
        self.sums = np.concatenate([np.zeros(1, np.int64), *levels[::-1]])

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def parts(self, leaf: int) -> list[tuple[int, int]]:
        """Length and count of each pre-token of a leaf."""
        if leaf in self.fine:
            return self.fine[leaf]
        length = self.starts[leaf + 1] - self.starts[leaf]
        return [(length, int(self.sums[leaf + self.width]))] if length else []

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and counts of all pre-tokens of the text as it is."""
        lengths = np.diff(np.array(self.starts, np.int64))
        counts = self.sums[self.width : self.width + len(lengths)]
        out, at = [], 0
        for leaf in [*sorted(self.fine), len(lengths)]:
            kept = at + np.flatnonzero(lengths[at:leaf])
            out.append(np.stack([lengths[kept], counts[kept]], axis=1))
            if leaf < len(lengths):
                out.append(np.array(self.fine[leaf], np.int64).reshape(-1, 2))
            at = leaf + 1
        return tuple(np.concatenate(out).T)

    def set(self, leaf: int, value: int) -> None:
        i = leaf + self.width
        change = value - self.sums[i]
        while change and i:
            self.sums[i] += change
            i //= 2

    def _before(self, place: int) -> int:
        """The leaf that begins CONTEXT leaves before a place, empty ones not counted."""
        leaf = bisect_left(self.starts, place)
        for _ in range(CONTEXT):
            leaf = bisect_left(self.starts, self.starts[leaf - 1]) if leaf else 0
        return leaf

    def apply(self, edits: list[Edit]) -> str:
        """Replace text[start:end] by the replacement for each edit, count again around them, and return the new text.

        Edits are code point ranges of the text; those out of order are sorted. Where edits overlap, the later one loses what
        an earlier one took. Ranges beyond the text are cut to it. Text and starts follow, so further calls may be made.
        """
        clean, before = [], 0
        for start, end, new in sorted(edits):
            start, end = max(start, before), max(min(end, len(self.text)), start, before)
            start = min(start, len(self.text))
            clean.append((start, max(start, end), new))
            before = clean[-1][1]
        out, at = [], 0
        for start, end, new in clean:
            out += [self.text[at:start], new]
            at = end
        changed = "".join([*out, self.text[at:]])
        regions = []  # first leaf, leaf behind, and new place less old place of what lies behind
        shift, done, k = 0, 0, 0  # shift: new place less old place, of what lies between edits
        while k < len(clean):
            first = max(done, self._before(clean[k][0]))
            first = min(first, max(len(self.starts) - 2, 0))
            at, parts = self.starts[first] + shift, []
            end, moved = clean[k][1], shift + len(clean[k][2]) - (clean[k][1] - clean[k][0])
            k += 1
            while True:
                while k < len(clean) and clean[k][0] <= at - moved + 1 and at - moved >= end:
                    end, moved = clean[k][1], moved + len(clean[k][2]) - (clean[k][1] - clean[k][0])
                    k += 1
                old = at - moved
                if old >= end:
                    leaf = bisect_left(self.starts, old)
                    if leaf < len(self.starts) and self.starts[leaf] == old and (k == len(clean) or self._before(clean[k][0]) > leaf):
                        break
                if at >= len(changed):
                    leaf = len(self.starts) - 1
                    if k == len(clean):
                        break
                    end, moved = clean[k][1], moved + len(clean[k][2]) - (clean[k][1] - clean[k][0])
                    k += 1
                    continue
                match = _PIECE.match(changed, at)
                parts.append(match.group())
                at = match.end()
                while k < len(clean) and clean[k][0] < at - moved:
                    end, moved = clean[k][1], moved + len(clean[k][2]) - (clean[k][1] - clean[k][0])
                    k += 1
            self.touched += len(parts)
            found = self.count(parts)
            counts, new = sum(found), list(zip(map(len, parts), found))
            self.n_parts += len(new) - sum(len(self.parts(i)) for i in range(first, leaf))
            if leaf > first or new:
                self.fine[first] = new if leaf > first else new + self.parts(first)
            for i in range(first + 1, leaf):
                self.fine.pop(i, None)
            if leaf > first or counts:
                self.set(first, counts + (int(self.sums[first + self.width]) if leaf <= first else 0))
            for i in range(first + 1, leaf):
                self.set(i, 0)
            regions.append((first, leaf, moved))
            shift, done = moved, leaf
        if regions:
            starts, firsts, leaves, moves = np.array(self.starts), *map(np.array, zip(*regions))
            last = np.searchsorted(firsts, np.arange(len(starts)), "left") - 1  # the last region that begins before a leaf
            new = starts + np.where(last >= 0, moves[last], 0)
            for first, leaf, moved in regions:  # leaves inside begin where the region ends
                new[first + 1 : leaf] = starts[leaf] + moved
            self.starts = new.tolist()
        self.text = changed
        return changed


def difference(old: str, new: str) -> list[Edit]:
    """The edit that makes new of old, from where they first differ to where they last do; none if they are equal."""
    if old == new:
        return []
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (old, new))
    n = min(len(a), len(b))
    unlike = a[:n] != b[:n]
    front = int(unlike.argmax()) if unlike.any() else n
    unlike = a[len(a) - n + front :][::-1] != b[len(b) - n + front :][::-1]
    back = int(unlike.argmax()) if unlike.any() else n - front
    return [(front, len(a) - back, new[front : len(b) - back])]


def repeated_lines(text: str) -> list[Edit]:
    """Deletes each line that has a word and equals an earlier line, with the newline after it."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line.strip():
            if line in seen:
                edits.append((at, min(at + len(line) + 1, len(text)), ""))
            seen.add(line)
        at += len(line) + 1
    return edits


_NUMBER = regex.compile(r"[0-9]{5,}")


def long_numbers(text: str) -> list[Edit]:
    """Replaces each run of five digits or more by one 0."""
    return [(m.start(), m.end(), "0") for m in _NUMBER.finditer(text)]


CLEANING = (repeated_lines, long_numbers)


def count_tokens(docs: DataFrame, edits: str | Sequence[Callable[[str], list[Edit]]] = CLEANING, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", trees: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Per row of docs: id, n_chars, n_pretokens, n_tokens, n_edits, n_reencoded (pre-tokens cut again), n_tokens_after, text_after;
    with keep also lengths and counts of the pre-tokens of text_after, from which ``tree_table`` makes a table of trees.

    edits are functions of the text, applied one after the other to what the last left, or the name of a column of docs, array<struct<start: int, end: int, replacement: string>>
    in code points. Null counts as no edits, and in an edit as 0 or the empty string. Null and empty texts have no tokens, and
    edits may still insert into them. Ids may be null or repeat; other columns are not read.

    trees is such a table of an earlier run with the same vocabulary: where it has a document's id, only what lies between the first and
    the last difference of its text and the tree's is counted (n_reencoded tells how much). Results are the same with any table, empty,
    stale or with repeated ids, of which one tree is taken. Null ids are counted in full.
    """
    given, stored = isinstance(edits, str), trees is not None
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([F.col(edits).alias("_edits")] if given else []))
    if stored:
        old = trees.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_of"), F.struct("text", "lengths", "counts").alias("_tree"))
        rows = rows.join(old.dropDuplicates(["_of"]), F.col("_id") == F.col("_of"), "left").drop("_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for piece in pieces(batches):
            own = piece.column("_edits").to_pylist() if given else None
            saved = piece.column("_tree") if stored else None
            out, kept = [], []
            for i, text in enumerate(piece.column(1).to_pylist()):
                text = text or ""
                before = saved[i] if saved is not None and saved[i].is_valid else None
                if before is None:
                    tree = Tree(text, count)
                else:
                    tree = Tree(before["text"].as_py() or "", count, tuple(before[c].values.to_numpy().astype(np.int64) for c in ("lengths", "counts")))
                    if changes := difference(tree.text, text):
                        tree.apply(changes)
                n_pretokens, n_tokens, n_edits = tree.n_parts, tree.total, 0
                for find in [lambda _, own=own[i]: [(e["start"] or 0, e["end"] or 0, e["replacement"] or "") for e in own or [] if e]] if given else edits:
                    if now := find(tree.text):
                        tree.apply(now)
                        n_edits += len(now)
                out.append((len(text), n_pretokens, n_tokens, n_edits, tree.touched, tree.total, tree.text))
                if keep:
                    kept.append(tree.flat())
            columns = [*[pa.array(c, pa.int64()) for c in list(zip(*out))[:6]], pa.array([r[6] for r in out], pa.string())]
            columns += [pa.array(c, pa.list_(pa.int32())) for c in zip(*kept)]
            yield pa.RecordBatch.from_arrays([piece.column(0), *columns], names)

    fields = "n_chars long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long, text_after string" + (", lengths array<int>, counts array<int>" if keep else "")
    schema = out_schema(docs, id_col, fields)
    names = schema.fieldNames()
    return rows.mapInArrow(run, schema)


def tree_table(counted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, text, lengths and counts: the trees of count_tokens with keep, to be written and given to a later run."""
    return counted.select(id_col, F.col("text_after").alias("text"), "lengths", "counts")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir)).select("doc_id", "n_chars", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after")
