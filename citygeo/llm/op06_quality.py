"""Quality rules: gradient-boosted trees over document statistics, as flat node arrays, under monotonic constraints.

Statistics are counted in one pass over whole texts. Trees are grown on the driver from the statistics of at most about
``bound`` labelled documents, chosen by a hash of their id. All nodes of all trees stand in five numpy arrays, and a batch of
documents goes down all trees a level at a time. A constraint of -1 on a feature means: more of it never raises the score.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import documents, out_schema, pieces

BOUND = 20_000
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_calls", "n_stops"]
# name and constraint of each feature
FEATURES = [("symbol_rate", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", -1), ("call_rate", -1), ("digit_share", 0), ("letter_share", 0), ("word_length", 0), ("stop_rate", 0)]
_OTHER, _LETTER, _UPPER, _DIGIT, _GAP, _SYMBOL, _CALL, _STOP = range(8)


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"Lu": _UPPER, "Lt": _UPPER, "Nd": _DIGIT}
    out = np.array([kind.get(c := unicodedata.category(chr(i)), _LETTER if c[0] == "L" else _OTHER) for i in range(sys.maxunicode + 1)], np.uint8)
    for chars, k in ((" \t\n\v\f\r", _GAP), (SYMBOLS, _SYMBOL), ("!?", _CALL), (".,;:", _STOP)):
        out[[ord(c) for c in chars]] = k
    return out


def _repeats(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    hit = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def statistics_of(text: str | None) -> list[int]:
    """COUNTS of one text; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = np.zeros(8, np.int64)
    for at in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        n += np.bincount(classes()[codes], minlength=8)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [len(words), len(text) - n[_GAP], n[_SYMBOL], len(lines) - len(set(lines)), _repeats(words), len(lines), n[_LETTER] + n[_UPPER], n[_UPPER], n[_DIGIT], n[_CALL], n[_STOP]]


def features(counts: np.ndarray) -> np.ndarray:
    c = dict(zip(COUNTS, counts.astype(float).T))
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_letters"], 1)
    return np.column_stack([c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_upper"] / letters, c["n_calls"] / words, c["n_digits"] / chars, c["n_letters"] / chars, c["word_chars"] / words, c["n_stops"] / words])


@dataclass
class Trees:
    """feature -1 marks a leaf; children of a leaf are itself."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, np.maximum(self.feature[node], 0)] <= self.limit[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.prior + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic loss, second order, splits from histograms of quantile bins. No rows or one class: a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.75
    prior = float(np.log(share / (1 - share)))
    empty = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return Trees(empty, empty, empty.astype(float), empty, empty, empty.astype(float), 0, prior)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    out = Trees(empty, empty, empty, empty, empty, empty, depth, prior)
    roots, nodes = [], []  # node: feature, limit, left, right, value
    total = np.full(len(y), prior)

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        weight = lambda a, b: np.clip(-a / (b + ridge), low, high)
        me, own = len(nodes), weight(g[rows].sum(), h[rows].sum())
        nodes.append([-1, 0.0, me, me, rate * own])
        gain_of = lambda w, a, b: -(a * w + 0.5 * (b + ridge) * w * w)
        base, best = gain_of(own, g[rows].sum(), h[rows].sum()), None
        if level < depth:
            for j, edge in enumerate(edges):
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(edge) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(edge) + 1))[:-1]
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                wl, wr = weight(gl, hl), weight(gr, hr)
                gain = gain_of(wl, gl, hl) + gain_of(wr, gr, hr) - base
                gain[(hl < least) | (hr < least) | (constraints[j] * (wl - wr) > 0)] = -np.inf
                if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                    k = int(gain.argmax())
                    best = (gain[k], j, k, wl[k], wr[k])
        if best is not None:
            _, j, k, wl, wr = best
            middle, down = (wl + wr) / 2, binned[rows, j] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[constraints[j]]
            left = build(rows[down], g, h, level + 1, *bounds[0])
            right = build(rows[~down], g, h, level + 1, *bounds[1])
            nodes[me] = [j, float(edges[j][k]), left, right, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(build(np.arange(len(y)), p - y, p * (1 - p), 0, -8.0, 8.0))
        f, t, l, r, v = zip(*nodes)
        out = Trees(np.array(roots), np.array(f), np.array(t), np.array(l), np.array(r), np.array(v), depth, prior)
        total = prior + np.log(np.maximum(s := out.score(x), 1e-12) / np.maximum(1 - s, 1e-12)) - prior
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from labels (id, quality 0/1): at most about bound of them, by a hash of the id. A document with several labels
    counts as its least; null labels and labels without document are left out. Rows with one id are one document, that with the
    least hash of its text, so what comes to the driver is bound by the ids."""
    own = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    share = min(1.0, bound / max(1, own.count()))
    picked = F.broadcast(own.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share * (1 << 20)))  # about bound rows at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked.withColumnRenamed(id_col, "_id"), "_id")
    rows = rows.groupBy("_id", "quality").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")).select("quality", "_text")
    found = rows.mapInArrow(_count_rows("quality"), out_schema(rows, "quality", ", ".join(f"{c} long" for c in COUNTS))).toArrow()
    counts = np.column_stack([found.column(c).to_numpy() for c in COUNTS]) if found.num_rows else np.zeros((0, len(COUNTS)))
    return grow(features(counts), found.column("quality").to_numpy().astype(float), [c for _, c in FEATURES])


def _count_rows(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            counts = np.array([statistics_of(t) for t in piece.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, counts.T.copy())], [key, *COUNTS])

    return run


def quality_rules(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, repeat_percent: int = 50, cut: float = 0.5) -> DataFrame:
    """Per row of docs: id, the statistics in COUNTS, base_failed, score (of the trees, 0 to 1) and kept.

    base_failed: under least_words words, or over repeat_percent % of the words in repeated 3-word windows. kept: not base_failed
    and a score of cut or more. Null and empty texts have zero counts and fail. Ids may be null or repeat; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            counts = np.array([statistics_of(t) for t in piece.column(1).to_pylist()], np.int64)
            words, repeats = counts[:, 0], counts[:, COUNTS.index("n_repeat_words")]
            failed = (words < least_words) | (100 * repeats > repeat_percent * words)
            score = trees.score(features(counts))
            yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, counts.T.copy()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= cut))], [id_col, *COUNTS, "base_failed", "score", "kept"])

    fields = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, out_schema(docs, id_col, fields))


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs, trees).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
