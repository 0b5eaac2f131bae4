"""What the near-duplicate operators share once nodes (different sets) have met in blocks: stars and tiles.

A star holds many nodes against one head, in chunks that each hold the head, so a star of any size is linear work. Tiles deal the blocks
that stars have not joined: the nodes of the component with most members of a block (near) and the rest (far), near by far and far by
far. A block that is nearly joined costs little, however large it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygeo.llm.common import checkpoint, pieces

Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def similar(a: np.ndarray, b: np.ndarray, percent: float) -> bool:
    """Whether 100 times the intersection of two sorted sets is ``percent`` times their union, or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def with_texts(docs: DataFrame, wanted: DataFrame, one: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """wanted (node, ...) with the text of one document of each node. Up to ``most`` rows of wanted (counted) are broadcast, so that only
    texts of wanted nodes are shuffled; beyond that documents are."""
    wanted = checkpoint(wanted.join(one.select("node", "one_id", "one_key"), "node"))
    few = wanted.count() <= most
    meet = (lambda part: F.broadcast(part)) if few else (lambda part: part)
    same = (F.col("key") == F.col("one_key")) & F.col("id").eqNullSafe(F.col("one_id"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    texts = texts.join(meet(wanted.select("one_id", "one_key").distinct()), same, "left_semi").dropDuplicates(["key", "id"])
    return texts.join(meet(wanted), same).drop("id", "key", "one_id", "one_key")


def _star_rows(sets: Sets, percent: float):
    """Links (a, b) between the first node of each group, its head, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, own = None, np.zeros(0, np.uint64), 0
        for piece in pieces(batches, 4):
            distinct, bounds = sets(piece.column(4))
            block, tile, member, node = (piece.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            a, b = [], []
            for i in range(piece.num_rows):
                mine = distinct[bounds[i] : bounds[i + 1]]
                if not member[i]:
                    last, head, own = (block[i], tile[i]), mine, node[i]
                elif last == (block[i], tile[i]) and similar(head, mine, percent):
                    a.append(own)
                    b.append(node[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def star_links(docs: DataFrame, pairs: DataFrame, one: DataFrame, sets: Sets, percent: float, id_col: str, text_col: str, tile: int, tile_shingles: int, most: int) -> DataFrame:
    """Links (a, b) of pairs (head, node, n shingles of the node), confirmed on the full sets that ``sets`` makes of texts."""
    chunks = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / tile_shingles)).cast("long")
    heads = pairs.groupBy("head").agg(chunks.alias("chunks"))
    members = pairs.join(heads, "head").select(F.col("head").alias("block"), F.pmod(F.xxhash64("node"), "chunks").alias("tile"), F.lit(True).alias("member"), "node")
    heads = heads.select(F.col("head").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("tile"), F.lit(False).alias("member"), F.col("head").alias("node"))
    rows = with_texts(docs, members.unionByName(heads), one, id_col, text_col, most).select("block", "tile", "member", "node", "text")
    return rows.repartition("block", "tile").sortWithinPartitions("block", "tile", "member").mapInArrow(_star_rows(sets, percent), "a long, b long")


def open_blocks(met: DataFrame) -> DataFrame:
    """The blocks of met (block, node, root) whose nodes have several roots; one of those with equal members."""
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    found = met.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), *members).filter("low < high")
    return found.groupBy("members", "x1", "x2").agg(F.min("block").alias("block")).select("block")


def tiles(met: DataFrame, tile: int, tile_shingles: int) -> DataFrame:
    """met (block, node, root, n, ...) of blocks with several roots, with tile: a number for each tile of its block that a node is in."""
    roots = met.groupBy("block", "root").agg(F.count("*").alias("own"), F.sum("n").alias("shingles"))
    parts = lambda own, shingles: F.greatest(F.ceil(own / tile), F.ceil(shingles / tile_shingles), F.lit(1)).cast("long")
    blocks = roots.groupBy("block").agg(F.max(F.struct("own", "root", "shingles")).alias("near"), F.sum("own").alias("all"), F.sum("shingles").alias("all_shingles"))
    blocks = blocks.select("block", F.col("near.root").alias("near"), parts(F.col("near.own"), F.col("near.shingles")).alias("n_near"), parts(F.col("all") - F.col("near.own"), F.col("all_shingles") - F.col("near.shingles")).alias("n_far"))
    dealt = met.join(blocks, "block")
    part = F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("near"), F.col("n_near")).otherwise(F.col("n_far")))
    across = F.when(F.col("root") == F.col("near"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_far") - 1), lambda j: F.col("part") * F.col("n_far") + j)).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_near") - 1), lambda i: i * F.col("n_far") + F.col("part")),
            F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_far") - 1), lambda j: (F.col("n_near") + F.least(j, F.col("part"))) * F.col("n_far") + F.greatest(j, F.col("part"))), lambda _: F.col("n_far") > 1),
        )
    )  # with one far part, its own pairs are in the first tile
    return dealt.withColumn("part", part).withColumn("tile", F.explode(across)).drop("part", "near", "n_near", "n_far")
