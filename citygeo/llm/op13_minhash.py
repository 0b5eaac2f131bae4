"""MinHash near-dedup with b-bit signatures.

Each text becomes its set of distinct shingles, hashed, and HASHES minima of that set under orders of their own. BANDS bands of ROWS
minima are block keys; of all minima the low BITS bits are kept and packed into longs. Equal sets are one node from then on.

Two nodes of a block are estimated from the number of fields in which their packed bits agree. Fields of unlike minima agree with a
chance of 2 ** -BITS, so the similarity is (agreement - chance) / (1 - chance). Pairs estimated MARGIN or more below the wanted
similarity are left out (six deviations at 0.8); the others are confirmed on their full sets, and only these are links.

Pairs are never listed. First each node is held against one other, the least node of all its blocks (a star); a star of any size
is dealt into chunks that each hold the head. Blocks whose nodes these links have joined are done. In the others, the nodes
of the component with most members (near) and the rest (far) are dealt into tiles: near by far, and far by far, so a block that is nearly
done costs little however large it is. A first pass over tiles moves signatures alone and returns the nodes that have a partner in another
component by estimate; a second one moves the texts of these nodes, confirms, and returns links that join components of its tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import checkpoint, documents, mix, out_schema, pieces
from citygeo.llm.near import open_blocks, similar, star_links, tiles, with_texts
from citygeo.llm.op02_simhash import components, set_hashes, shingle_table

HASHES, BITS, BANDS, ROWS, MARGIN = 128, 2, 20, 3, 0.25
FIELDS = 64 // BITS
LOW = sum(1 << i for i in range(0, 64, BITS))  # the lowest bit of each field
TILE, TILE_SHINGLES = 1024, 1 << 18  # nodes of one side of a tile, and their shingles; a longer text is a tile with few others
MOST = 200_000  # rows of a few numbers that may be broadcast
LANES, BYTES = 1 << 16, 4 << 20
SIG = [f"s{k}" for k in range(HASHES // FIELDS)]
_ORDERS = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) | np.uint64(1)


def minima(distinct: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES minima of each set distinct[bounds[i]:bounds[i + 1]]. No set may be empty."""
    if len(bounds) == 1:
        return np.zeros((0, HASHES), np.uint64)
    return np.stack([np.minimum.reduceat(distinct * order, bounds[:-1]) for order in _ORDERS], axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(_ORDERS[:BANDS], (len(least), BANDS)).copy()
    for row in range(ROWS):
        keys = mix(keys ^ least[:, row * BANDS : (row + 1) * BANDS])
    return keys


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the (spread) minima, FIELDS of them to a number."""
    low = (mix(least) & np.uint64((1 << BITS) - 1)).reshape(len(least), len(SIG), FIELDS)
    return np.bitwise_or.reduce(low << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def agreement(least: float) -> int:
    """Fields in which two signatures agree at least, if their similarity is ``least`` by estimate."""
    chance = 2.0**-BITS
    return int(np.ceil(HASHES * (chance + (1 - chance) * max(least, 0.0))))


def estimated(agree: np.ndarray) -> np.ndarray:
    """Similarities from numbers of fields that agree, corrected for agreement by chance."""
    chance = 2.0**-BITS
    return (agree / HASHES - chance) / (1 - chance)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fields in which signatures x and y (rows of longs) agree."""
    unlike = x ^ y
    for k in range(1, BITS):
        unlike = unlike | (x ^ y) >> np.uint64(k)
    return HASHES - np.bitwise_count(unlike & np.uint64(LOW)).sum(axis=-1, dtype=np.int64)


def _agreeing(left: str, right: str) -> Column:
    """The same of columns named left.s0, right.s0, ..."""
    unlike = [F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}")) for s in SIG]
    for k, x in enumerate(unlike):
        for by in range(1, BITS):
            unlike[k] = unlike[k].bitwiseOR(F.shiftrightunsigned(x, by))
    return F.lit(HASHES) - sum(F.bit_count(x.bitwiseAND(F.lit(LOW))) for x in unlike)


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            distinct, bounds = shingle_table(piece.column(1), width)
            full = np.flatnonzero(np.diff(bounds))
            least = minima(distinct, np.r_[bounds[full], len(distinct)])
            edge = np.r_[0, np.cumsum(np.where(np.diff(bounds) > 0, BANDS, 0))]
            sigs = np.zeros((len(SIG), piece.num_rows), np.uint64)
            sigs[:, full] = packed(least).T
            size = pc.fill_null(pc.binary_length(piece.column(1)), 0).cast(pa.int64())
            bands = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(band_keys(least).view(np.int64).ravel()))
            longs = [pa.array(c.view(np.int64)) for c in (set_hashes(distinct, bounds), *sigs)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), size, pa.array(np.diff(bounds)), *longs, bands], ["id", "key", "size", "n", "node", *SIG, "bands"])

    return run


def minhash_sets(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (hash of the text), size (bytes), n (size of the set), node (64-bit hash of the set), s0, s1, ... (its signature) and bands of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    return rows.mapInArrow(_set_rows(shingle), out_schema(rows, "id", f"key long, size long, n long, node long, {', '.join(f'{s} long' for s in SIG)}, bands array<long>"))


def _groups(batches: Iterator[pa.RecordBatch], text: bool) -> Iterator[pa.Table]:
    """Rows sorted by their first two columns, some whole groups (equal in both) at a time; text: the last column is one."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    last = None
    for batch in pieces(batches, -1) if text else batches:
        if not batch.num_rows:
            continue
        block, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.r_[last != (block[0], tile[0]), (np.diff(block) != 0) | (np.diff(tile) != 0)])
        last = block[-1], tile[-1]
        if len(cut) and held and (count + batch.num_rows > LANES or size > BYTES):
            held += [batch.slice(0, cut[-1])] if cut[-1] else []
            yield pa.Table.from_batches(held)
            held, count, size, batch = [], 0, 0, batch.slice(cut[-1])
        held.append(batch)
        count, size = count + batch.num_rows, size + batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _edges(table: pa.Table) -> np.ndarray:
    block, tile = table.column(0).to_numpy(), table.column(1).to_numpy()
    return np.r_[np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(tile) != 0)]), table.num_rows]


def _sets_of(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of the last column: their members, and where each set begins."""
    found = [shingle_table(piece.column(0), width) for piece in pieces(iter(table.select([table.num_columns - 1]).to_batches()), 0)]
    return np.concatenate([d for d, _ in found]), np.r_[0, np.cumsum(np.concatenate([np.diff(b) for _, b in found]))]


def _partners(i: int, sigs: np.ndarray, n: np.ndarray, label: np.ndarray, percent: int, agree: int) -> np.ndarray:
    """Places beyond i with another label that may be similar to i, by size and by estimate."""
    j = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i])))
    return j[agreeing(sigs[j], sigs[i]) >= agree] if len(j) else j


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    node, root, n = (table.column(c).to_numpy() for c in ("node", "root", "n"))
    return node, root, n, np.stack([table.column(s).to_numpy() for s in SIG], axis=1).view(np.uint64)


def _wanted_rows(percent: int, agree: int):
    """block, tile and node of the nodes that have a partner in another component of their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, False):
            _, root, n, sigs = _columns(table)
            wanted, edge = np.zeros(table.num_rows, bool), _edges(table)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for i in range(hi - lo - 1):
                    j = _partners(i, sigs[lo:hi], n[lo:hi], root[lo:hi], percent, agree)
                    if len(j):
                        wanted[lo + i] = wanted[lo + j] = True
            yield from table.select(["block", "tile", "node"]).filter(pa.array(wanted)).combine_chunks().to_batches()

    return run


def _link_rows(width: int, percent: int, agree: int):
    """Links (a, b) between nodes of a tile that are similar and that join components of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, True):
            node, root, n, sigs = _columns(table)
            distinct, bounds = _sets_of(table, width)
            edge, a, b = _edges(table), [], []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                label = root[lo:hi].copy()
                for i in range(hi - lo - 1):
                    for j in _partners(i, sigs[lo:hi], n[lo:hi], label, percent, agree).tolist():
                        x, y = lo + i, lo + j
                        if label[i] != label[j] and similar(distinct[bounds[x] : bounds[x + 1]], distinct[bounds[y] : bounds[y + 1]], percent):
                            a.append(node[x])
                            b.append(node[y])
                            label[label == label[j]] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _stars(docs: DataFrame, met: DataFrame, one: DataFrame, shingle: int, percent: int, agree: int, id_col: str, text_col: str) -> DataFrame:
    """Links between nodes and the least node of all their blocks."""
    pairs = met.groupBy("node").agg(F.min("head").alias("head")).filter("head < node")
    both = pairs.join(one.select("node", F.struct(*SIG).alias("x"), F.col("n").alias("n_x")), "node")
    both = both.join(one.select(F.col("node").alias("head"), F.struct(*SIG).alias("y"), F.col("n").alias("n_y")), "head")
    fits = (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent) & (_agreeing("x", "y") >= agree)
    pairs = checkpoint(both.filter(fits).select("head", "node", F.col("n_x").alias("n")))
    sets = partial(shingle_table, width=shingle)
    return star_links(docs, pairs, one, sets, percent, id_col, text_col, TILE, TILE_SHINGLES, MOST)


def near_components(docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles (size of its set), component_id (least id reachable over links, its own included) and kept (whether
    that is its own id).

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles, confirmed on full sets; sets and shingles are
    told apart by 64-bit hashes. A pair is found if it shares a band, or is joined by others that do: at 0.8 a pair shares none with a
    chance of (1 - 0.8 ** ROWS) ** BANDS, below one in a million. Letters A-Z are lowered. A text of fewer words than a shingle is one shingle.
    Null, empty and wordless texts have no set and are linked with nothing, not even with each other. Rows with null ids are linked
    too; component_id is null, and they are kept, only if all ids of their component are. Repeated rows and equal ids stay as they
    are given. Other columns of docs are not read. An empty table gives no rows.
    """
    agree = agreement(percent / 100 - MARGIN)
    base = checkpoint(minhash_sets(docs, shingle, id_col, text_col))
    full = base.filter("n > 0")
    one = full.groupBy("node").agg(F.min(F.struct("size", "id", "key")).alias("one"), *[F.first(c).alias(c) for c in ("n", *SIG, "bands")])
    keyed = one.select(F.explode("bands").alias("block"), "node")
    sizes = keyed.groupBy("block").agg(F.count("*").alias("members"), F.min("node").alias("head")).filter("members > 1")
    met = checkpoint(keyed.join(sizes, "block").select("block", "node", "head"))
    one = one.join(met.select("node").distinct(), "node", "left_semi")
    one = checkpoint(one.select("node", "n", *SIG, F.col("one.size").alias("size"), F.col("one.id").alias("one_id"), F.col("one.key").alias("one_key")))

    first = components(_stars(docs, met, one, shingle, percent, agree, id_col, text_col)).toDF("linked", "to")
    own = checkpoint(one.select("node", "n", *SIG).join(first, F.col("node") == F.col("linked"), "left").select("node", "n", *SIG, F.coalesce("to", "node").alias("root")))

    met = met.select("block", "node").join(own, "node")
    dealt = checkpoint(tiles(met.join(open_blocks(met), "block"), TILE, TILE_SHINGLES)).repartition("block", "tile").sortWithinPartitions("block", "tile")
    wanted = checkpoint(dealt.select("block", "tile", "node", "root", "n", *SIG).mapInArrow(_wanted_rows(percent, agree), "block long, tile long, node long"))
    rows = with_texts(docs, wanted.join(own, "node"), one, id_col, text_col, MOST).select("block", "tile", "node", "root", "n", *SIG, "text")
    links = rows.repartition("block", "tile").sortWithinPartitions("block", "tile").mapInArrow(_link_rows(shingle, percent, agree), "a long, b long")
    roots = own.select("node", "root")
    links = links.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    second = components(links).toDF("linked", "to")
    roots = roots.join(second, F.col("root") == F.col("linked"), "left").select("node", F.coalesce("to", "root").alias("root"))

    named = full.groupBy("node").agg(F.min("id").alias("least")).join(roots.withColumnRenamed("node", "there"), F.col("node") == F.col("there"), "left")
    named = named.select("node", "least", F.coalesce("root", "node").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = full.join(named, "node").select("id", "n", "component_id").unionByName(base.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))
