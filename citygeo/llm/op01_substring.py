"""Substring dedup: recurring phrases are confirmed by counts, and sharded Aho-Corasick automata locate them in all documents.

1. *Seeds.* Of the 8-word phrases in each window of ``window`` words the one with the least hash is the window's seed, so
   equal windows have equal seeds. Neighbouring windows with one seed form a stretch; its hash is kept with the seed
   (about 7 rows per 100 words are shuffled, and only hashes).
2. *Confirmation.* A seed that occurs once cannot belong to a recurring window. If all stretches of a seed are equal and
   there are two or more, all their windows recur. Else the windows themselves are counted by their hash, across shards.
3. *Automata.* Documents are dealt into shards by a hash. The words of each confirmed phrase of a shard are read once, at its
   first place there; the different phrases are compiled into one automaton, and all documents of the shard are streamed
   through it. Where it hits, the windows that have the phrase as their seed are removed: all of them if the phrase's
   stretches are equal, else those whose own count is confirmed.

No group is collected: seeds are counted with map-side sums, after the texts at hand (about 1 MB) have been summed up, and a
window has at most one row for each shard. Recurrence is told by 64-bit hashes, places by the automata's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citygeo.llm.common import Words, checkpoint, documents, mix, out_schema, pieces, raw_text, span_hashes, text_bytes, word_hashes

PHRASE = 8
SHARD_BYTES, SHARDS_PER_TASK, HELD_BYTES = 8 << 20, 16, 16 << 20
MOST_REPEATED = 1_000_000  # hashes of repeated rows that may be broadcast
ALIKE, DIFFERING, WINDOW = range(3)  # seeds whose stretches are equal, others, and confirmed windows
_SECOND = 0xD6E8FEB86659FD93


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value among width values from each position on."""
    at, low, span = np.arange(len(values)), values, 1
    while span < width:
        step = min(span, width - span)
        a, b = low[:-step], low[step:]
        later = b < a
        at, low = np.where(later, at[step:], at[:-step]), np.where(later, b, a)
        span += step
    return at


class _Windows:
    """All windows of some texts: first word, hash of the seed phrase, and the words' hashes."""

    def __init__(self, column: pa.Array, window: int):
        self.words = Words(*raw_text(column))
        self.hashes = word_hashes(self.words)
        n, phrase = len(self.words), min(PHRASE, window)
        self.window, self.first, self.seed_at = window, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < window:
            return
        begins = np.arange(n - phrase + 1)
        grams = span_hashes(self.hashes, begins, begins + phrase)
        seed_at = _leftmost_min(grams, window - phrase + 1)
        room = np.repeat(self.words.doc[1:], np.diff(self.words.doc))[: len(seed_at)]
        self.first = np.flatnonzero(np.arange(len(seed_at)) + window <= room)
        self.seed_at = seed_at[self.first]
        self.seed = grams[self.seed_at]

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seed, hash of the whole stretch, and first window's word, for each stretch of windows with one seed."""
        if not len(self.first):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), self.first
        cut = np.flatnonzero(np.r_[True, (np.diff(self.seed_at) != 0) | (np.diff(self.first) != 1)])
        start, last = self.first[cut], self.first[np.r_[cut[1:], len(self.first)] - 1]
        whole = span_hashes(self.hashes, start, last + self.window, _SECOND)
        return self.seed[cut], mix(whole ^ (self.seed_at[cut] - start).astype(np.uint64)), start

    def window_hashes(self, which: np.ndarray) -> np.ndarray:
        start = self.first[which]
        return span_hashes(self.hashes, start, start + self.window, _SECOND)


def _doc_of(words: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.doc, at, "right") - 1


def _seed_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            w = _Windows(piece.column(1), window)
            seed, whole, start = w.stretches()
            shard = piece.column(0).to_numpy(zero_copy_only=False)[_doc_of(w.words, start)]
            whole, order = whole.view(np.int64), np.lexsort((shard, seed))
            seed, whole, shard = seed[order].view(np.int64), whole[order], shard[order]
            first = np.flatnonzero(np.r_[True, (np.diff(seed) != 0) | (np.diff(shard) != 0)]) if len(seed) else order
            sides = [f.reduceat(whole, first) if len(seed) else whole for f in (np.minimum, np.maximum)]
            columns = [seed[first], shard[first].astype(np.int32), np.diff(np.r_[first, len(seed)]), *sides]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["seed", "shard", "n", "low", "high"])

    return run


def _open_windows(window: int):
    """Windows of seeds whose stretches differ: once for each shard, with their count there."""

    def run(docs: pa.Table, seeds: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        shard = (docs if docs.num_rows else seeds).column("shard")[0].as_py()
        if docs.num_rows and seeds.num_rows:
            wanted = np.unique(seeds.column("seed").to_numpy()).view(np.uint64)
            for piece in pieces(iter(docs.select(["shard", "text"]).to_batches())):
                w = _Windows(piece.column(1), window)
                if len(w.first):
                    found.append(w.window_hashes(np.flatnonzero(np.isin(w.seed, wanted))))
        keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.table({"shard": pa.array(np.full(len(keys), shard), pa.int32()), "key": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    return run


class _Coder:
    """Words as short strings for the automaton: frequent words take one sign, others a lead sign and one or two tail
    signs. Leads and tails are disjoint, so a hit always begins and ends with a word, and no node has many children."""

    ONE, TAIL, LEAD2 = 64, 64, 32

    def __init__(self, by_rank: int):
        one, tail, lead2 = self.ONE, self.TAIL, self.LEAD2
        sign, two = [chr(0x100 + i) for i in range(tail + 2 * one + lead2 + 1024)], lead2 * tail
        tails, ones, leads2, leads3 = sign[:tail], sign[tail : tail + one], sign[tail + one : tail + one + lead2], sign[tail + one + lead2 :]
        self.codes = ["\x01"]
        for i in range(by_rank):
            if i < one:
                self.codes.append(ones[i])
            elif i < one + two:
                a, b = divmod(i - one, tail)
                self.codes.append(leads2[a] + tails[b])
            else:
                a, b = divmod(i - one - two, tail)
                c, a = a % tail, a // tail
                lead = leads3[a] if a < len(leads3) else chr(0x10000 + a)
                self.codes.append(lead + tails[c] + tails[b])
        self.length = np.array([len(c) for c in self.codes], np.int64)


class PhraseAutomaton:
    """Finds all places of some phrases (rows of word hashes, all of one length), and tells which phrase stands there."""

    def __init__(self, phrases: np.ndarray):
        self.width, self.kinds = phrases.shape[1], np.zeros(0, np.uint64)
        if not len(phrases):
            return
        self.kinds, back, counts = np.unique(phrases, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.kinds), np.int64)
        self.rank[np.argsort(-counts, kind="stable")] = np.arange(1, len(self.kinds) + 1)
        coder = _Coder(len(self.kinds))
        self.codes, self.length = np.array(coder.codes, object), coder.length
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, signs in enumerate(self.codes[self.rank[back.reshape(phrases.shape)]].tolist()):
            self.automaton.add_word("".join(signs), k)
        self.automaton.make_automaton()

    def places(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of each place in documents (bounds in doc), and the number of the phrase there."""
        if not len(self.kinds) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.kinds, hashes), len(self.kinds) - 1)
        ids = np.where(self.kinds[at] == hashes, self.rank[at], 0)
        code_end = np.cumsum(self.length[ids])
        signs = self.codes[ids].tolist()
        ends: list[int] = []
        which: list[int] = []
        for a, b in zip(doc[:-1].tolist(), doc[1:].tolist()):
            if b - a >= self.width:
                base = int(code_end[a - 1]) if a else 0
                for end, k in self.automaton.iter("".join(signs[a:b])):
                    ends.append(base + end)
                    which.append(k)
        return np.searchsorted(code_end, np.array(ends, np.int64), "right") - self.width + 1, np.array(which, np.int64)


def _phrases(parts: Iterator[_Windows], wanted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each wanted seed at its first place, as hashes, and the seeds in the same order."""
    rows, seeds, left = [np.zeros((0, width), np.uint64)], [np.zeros(0, np.uint64)], wanted
    for w in parts:
        if len(w.first) and len(left):
            new, at = np.unique(w.seed, return_index=True)
            own = np.isin(new, left)
            rows.append(w.hashes[w.seed_at[at[own]][:, None] + np.arange(width)])
            seeds.append(new[own])
            left = np.setdiff1d(left, new[own])
    return np.concatenate(rows), np.concatenate(seeds)


def _mark(window: int):
    """Spans of removed words and the kept text of each document of a shard."""
    width = min(PHRASE, window)

    def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
        kind, key = keys.column("kind").to_numpy(), keys.column("key").to_numpy().view(np.uint64)
        alike, differing, windows = (np.unique(key[kind == k]) for k in (ALIKE, DIFFERING, WINDOW))
        batches, held = docs.select(["shard", "text", "id"]), docs.nbytes <= HELD_BYTES
        known = [_Windows(piece.column(1), window) for piece in pieces(iter(batches.to_batches()))] if held else None
        again = lambda: known or (_Windows(piece.column(1), window) for piece in pieces(iter(batches.to_batches())))
        rows, seeds = _phrases(iter(again()), np.union1d(alike, differing), width)
        automaton, whole = PhraseAutomaton(rows), np.isin(seeds, alike)
        ids, n_words, n_removed, kept, spans = [], [], [], [], []
        for piece, w in zip(pieces(iter(batches.to_batches())), again()):
            hit = np.zeros(len(w.words) + 1, np.int64)
            at, which = automaton.places(w.hashes, w.words.doc)
            if len(at) and len(w.first):
                state = np.zeros(len(w.words), np.int8)
                state[at] = np.where(whole[which], 1, 2)
                of_window = state[w.seed_at]
                open_ = np.flatnonzero(of_window == 2)
                starts = np.r_[w.first[of_window == 1], w.first[open_[np.isin(w.window_hashes(open_), windows)]]]
                np.add.at(hit, starts, 1)
                np.add.at(hit, starts + window, -1)
            gone = np.cumsum(hit[:-1]) > 0
            total = np.r_[0, np.cumsum(gone)]
            texts = piece.column(1).to_pylist()
            for i, (a, b) in enumerate(zip(w.words.doc[:-1].tolist(), w.words.doc[1:].tolist())):
                words, lost = (texts[i] or "").encode().split(), int(total[b] - total[a])
                n_words.append(b - a)
                n_removed.append(lost)
                kept.append(b" ".join(compress(words, ~gone[a:b]) if lost else words))
                if lost:
                    edge = np.diff(np.r_[0, gone[a:b].astype(np.int8), 0])
                    spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
                else:
                    spans.append([])
            ids.append(piece.column(2))
        kind_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        id_type = docs.schema.field("id").type
        return pa.table({"id": pa.chunked_array(ids, id_type), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(spans, kind_of)})

    return run


def told_once(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, copy and times: rows of docs, but of rows equal in both only two, copy 0 that stands for all of them (times) and copy 1
    (times 0): with two of them every window of theirs recurs, as with all. Equal rows are counted by a hash first; only they are grouped."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    repeated = checkpoint(rows.groupBy("row").agg(F.count("*").alias("times")).filter("times > 1"))
    n = repeated.count()
    single = lambda df: df.select("id", "text", F.lit(0).alias("copy"), F.lit(1).cast("long").alias("times"))
    if not n:
        return single(rows)
    meet = F.broadcast(repeated) if n <= MOST_REPEATED else repeated
    several = rows.join(meet, "row").groupBy("row", "id", "times").agg(F.first("text").alias("text"))
    both = several.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select("id", "text", "copy", F.when(F.col("copy") == 0, F.col("times")).otherwise(0).alias("times"))
    return single(rows.join(meet, "row", "left_anti")).unionByName(both)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_text (kept words joined by a space) and removed (word spans).

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in the same document or another.
    Null and empty texts have no words and give an empty kept text. Ids may be null or repeat: every row is a document of
    its own, so equal rows repeat each other; however many they are, two of them are looked at, in shards of their own. Other
    columns of docs are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shards = shards or max(1, -(-text_bytes(docs, text_col) // SHARD_BYTES))
    rows = told_once(docs, id_col, text_col).select(F.pmod(F.xxhash64("id", "text", "copy"), F.lit(shards)).cast("int").alias("shard"), "text", F.struct("id", "times").alias("id"))
    stretches = rows.select("shard", "text").mapInArrow(_seed_rows(window), "seed long, shard int, n long, low long, high long")
    seeds = stretches.groupBy("seed").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    seeds = seeds.filter("n > 1").select("seed", (F.col("low") != F.col("high")).alias("differs"))
    known = stretches.select("seed", "shard").join(seeds, "seed")
    tasks = shards // SHARDS_PER_TASK  # more than the session's only for large inputs
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, "shard")
    dealt = rows.groupBy("shard")
    counted = dealt.cogroup(known.filter("differs").select("shard", "seed").groupBy("shard")).applyInArrow(_open_windows(window), "shard int, key long, n long")
    total = F.sum("n").over(Window.partitionBy("key"))
    windows = counted.withColumn("total", total).filter("total > 1").select("shard", F.lit(WINDOW).alias("kind"), "key")
    keys = known.select("shard", F.when(F.col("differs"), DIFFERING).otherwise(ALIKE).alias("kind"), F.col("seed").alias("key")).unionByName(windows)
    schema = out_schema(rows, "id", "n_words long, n_removed long, kept_text string, removed array<struct<start: long, end: long>>")
    marked = dealt.cogroup(keys.groupBy("shard")).applyInArrow(_mark(window), schema).filter("id.times > 0")
    every = marked.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "id.times")))
    return every.select(F.col("id.id").alias(id_col), "n_words", "n_removed", "kept_text", "removed")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
