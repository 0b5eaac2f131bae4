"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lowered. The seeds of a benchmark item are hashes of its runs of ``seed`` words. A
document that shares a seed with an item is tiled against it: Running Karp-Rabin finds the longest common runs of unmarked
words, longest first, and marks them in both; rounds go on with shorter lengths down to ``seed``. The share of the item's
words under tiles is its coverage; order does not matter, so passages with sentences in another order are caught.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words, the proven bound of what a task holds; each block is
one pass over the documents. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import Words, checkpoint, documents, out_schema, pieces, raw_text, span_hashes, word_hashes

BLOCK_WORDS = 2_000_000
MEETINGS = 1 << 22  # of seeds of documents with places in items, at a time; a single document may have more
SEED_WORDS, COVERAGE = 4, 0.5

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_PLAIN[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_PLAIN[ord("a") : ord("z") + 1] = _PLAIN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lowered words of some texts, and the word at which each text begins."""
    data, offsets = raw_text(pc.utf8_lower(column.cast(pa.large_string())))
    words = Words(_PLAIN[data], offsets)
    return word_hashes(words), words.doc


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    start = np.arange(max(0, len(words) - n + 1))
    return span_hashes(words, start, start + n)


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of a greedy tiling by Running Karp-Rabin: in each round hashes of the search
    length find candidates among unmarked words, each is extended as far as it goes, and the longest are marked first, ties by
    place in doc, then in item."""
    free_d, free_i, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []
    length = 1 << max(least, len(item)).bit_length() - 1

    def reach(i: int, j: int) -> int:
        """Words from i and j on that are alike and free in both."""
        n, step = 0, 64
        while m := min(step, len(doc) - i - n, len(item) - j - n):
            alike = (doc[i + n : i + n + m] == item[j + n : j + n + m]) & free_d[i + n : i + n + m] & free_i[j + n : j + n + m]
            if not alike.all():
                return n + int(alike.argmin())
            n, step = n + m, 4 * step
        return n

    while True:
        length = max(length, least)
        grams = _grams(item, length)
        order = np.argsort(grams, kind="stable")
        free = np.r_[0, np.cumsum(~free_i)]
        order = order[free[order + length] == free[order]] if len(order) else order
        known = grams[order]
        hashes, found = _grams(doc, length), []
        taken = np.r_[0, np.cumsum(~free_d)]
        where = np.flatnonzero(np.isin(hashes, known))
        for i in where[taken[where + length] == taken[where]].tolist():
            places = order[np.searchsorted(known, hashes[i], "left") : np.searchsorted(known, hashes[i], "right")]
            if i and free_d[i - 1]:  # what begins earlier is left to its beginning
                places = places[(places == 0) | ~free_i[places - 1] | (item[places - 1] != doc[i - 1])]
            for j in places.tolist():
                n = reach(i, j)
                if n >= length:
                    found.append((-n, i, j))
        heapify(found)
        while found:
            n, i, j = heappop(found)
            both = free_d[i : i - n] & free_i[j : j - n]
            if both.all():
                free_d[i : i - n] = free_i[j : j - n] = False
                tiles.append((i, j, -n))
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, both, False]))  # what longer tiles left of it takes its turn by its length
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= length:
                    heappush(found, (a - b, i + a, j + a))
        if length == least:
            return tiles
        length //= 2


def _tile_rows(items: list, words: np.ndarray, doc: np.ndarray, seed: int, coverage: float, id_col: str):
    """Tiling of documents against one block of items; words and doc are as from plain_words."""
    owner = np.repeat(np.arange(len(items)), np.diff(doc))
    grams, whole = _grams(words, seed), np.flatnonzero(np.diff(doc) > 0)
    start = np.arange(len(grams))
    inside = owner[start] == owner[start + seed - 1] if len(grams) else np.zeros(0, bool)
    seeds = grams[inside]
    short = [k for k in whole.tolist() if doc[k + 1] - doc[k] < seed]  # these match only as a whole
    order = np.argsort(seeds, kind="stable")
    seeds, place = seeds[order], start[inside][order]
    kinds = np.unique(seeds)
    need = coverage * np.diff(doc)

    def candidates(hashes: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) whose shared seeds cover the item enough, from distinct pairs of seed and text (sorted by text); some texts at a time."""
        low, high = np.searchsorted(seeds, hashes, "left"), np.searchsorted(seeds, hashes, "right")
        total = np.r_[0, np.cumsum(high - low)]
        at = 0
        while at < len(hashes):
            to = max(int(np.searchsorted(total, total[at] + MEETINGS, "right")) - 1, at + 1)
            to = int(np.searchsorted(text, text[to - 1], "right"))  # whole texts
            size = (high - low)[at:to]
            index = np.repeat(low[at:to] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            where, own = place[index], np.repeat(text[at:to], size)
            order = np.lexsort((where, own))
            where, own = where[order], own[order]
            item = owner[where]
            new = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(item) != 0)]) if len(own) else np.zeros(0, np.int64)
            step = np.full(len(where), seed)
            step[:-1] = np.where((np.diff(own) == 0) & (np.diff(item) == 0), np.minimum(np.diff(where), seed), seed)
            covered = np.add.reduceat(step, new) if len(new) else step
            enough = covered >= need[item[new]]
            yield from zip(own[new][enough].tolist(), item[new][enough].tolist())
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            own, bounds = plain_words(piece.column(1))
            hashes = _grams(own, seed)
            where = np.flatnonzero(np.isin(hashes, kinds))
            text = np.searchsorted(bounds, where, "right") - 1
            where = where[where + seed <= bounds[text + 1]] if len(where) else where
            text = np.searchsorted(bounds, where, "right") - 1
            own_seed = hashes[where]
            order = np.lexsort((own_seed, text))
            own_seed, text = own_seed[order], text[order]
            once = np.flatnonzero(np.r_[True, (np.diff(own_seed) != 0) | (np.diff(text) != 0)]) if len(text) else order
            pairs = set(candidates(own_seed[once], text[once]))  # tiles lie within shared seeds
            for k in short:
                n = int(doc[k + 1] - doc[k])
                for i in np.flatnonzero(np.isin(_grams(own, n), _grams(words[doc[k] : doc[k + 1]], n))).tolist():
                    t = int(np.searchsorted(bounds, i, "right") - 1)
                    if i + n <= bounds[t + 1]:
                        pairs.add((t, k))
            rows = []
            for t, k in sorted(pairs):
                item = words[doc[k] : doc[k + 1]]
                tiles = greedy_tiles(own[bounds[t] : bounds[t + 1]], item, min(seed, len(item)))
                got = sum(n for _, _, n in tiles)
                if got >= coverage * len(item):
                    rows.append((t, items[k], len(tiles), got, len(item), got / len(item), [{"start": a, "end": a + n} for a, _, n in sorted(tiles)]))
            columns = list(zip(*rows)) if rows else [[]] * 7
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            at = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0).take(at), piece.column(2).take(at), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.int64()) for c in columns[2:5]], pa.array(columns[5], pa.float64()), pa.array(columns[6], spans)], [id_col, "text_key", "item_id", "n_tiles", "tiled_words", "item_words", "coverage", "spans"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = SEED_WORDS, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of a document and a benchmark item (item_id, text) whose words are tiled to ``coverage`` or more.

    Returns id, text_key (64-bit hash of the text), item_id, n_tiles, tiled_words, item_words, coverage and spans (word ranges in the document). Items without words
    (or null) and documents without words match nothing; an item shorter than ``seed`` must occur whole. Equal items and equal
    documents each count. Ids may be null or repeat. Other columns are not read. No benchmark: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    schema = out_schema(docs, id_col, "text_key long, item_id long, n_tiles long, tiled_words long, item_words long, coverage double, spans array<struct<start: long, end: long>>")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sizes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-sizes // (2 * block_words)))  # a word and its gap take two bytes at least
    out = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        words, doc = plain_words(part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string()))
        found = rows.mapInArrow(_tile_rows(part.column("item_id").to_pylist(), words, doc, seed, coverage, id_col), schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1_000_000) -> DataFrame:
    """Rows of docs that are not in found (contamination of docs). Rows are told apart by id and text, so of rows with equal or
    null ids only those with a contaminated text go, and all of them. Up to ``most`` rows of found (counted) are broadcast, so
    that documents are not shuffled; beyond that the join shuffles. Columns of docs may have any names."""
    gone = checkpoint(found.select(F.col(id_col).alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    same = (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id"))
    return rows.join(F.broadcast(gone) if gone.count() <= most else gone, same, "left_anti").select("row.*")


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_tiles", "tiled_words", "item_words", "coverage")
