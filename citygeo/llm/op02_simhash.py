"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: one bit is 1 if it is set in over half the hashes of a text's shingles. With ``blocks="parts"`` these are XXH64
hashes, repeats included; equal fingerprints are one node from then on, so copies are never compared. With
``blocks="shingles"`` they are hashes of the distinct shingles, 128 bits of them make a sketch, and equal sets are one node.

Blocks: with ``blocks="parts"`` the 64 bits are cut into radius + 1 + extra parts, and nodes that agree in extra + 1 of them
meet (by the pigeonhole rule all links within the radius do; extra grows with the number of nodes, so blocks stay small).
With ``blocks="shingles"``, for radii that parts cannot serve, those meet that share ROWS least shingle hashes in one of BANDS
bands; blocks with equal members are one. A large block is dealt into tiles, and each pair of tiles becomes a block of its own; with
``blocks="shingles"`` stars join most nodes before, and tiles hold what they left (near.py).

Comparison: bit planes of the nodes of all blocks of a task stand vertically, one lane a node. For shift s, lane i is
compared with lane i + s by XOR of planes; a carry-save adder takes three planes at a time into bitwise counters that
overflow beyond the radius, and the shift is given up once every lane has overflowed.

With ``blocks="shingles"`` sketches within the radius only find candidates. The text of one document a node comes along with the
block, and the candidate pairs of a shift that are not joined yet are links if the similarity of their shingle sets, counted
exactly (for large blocks over bit rows of their common shingles), is high enough.

Only links that join two parts of a block are returned, so a task returns fewer links than it has nodes. Components follow
from large-star and small-star rounds over tables; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from citygeo.llm.common import Words, checkpoint, chosen, documents, mix, out_schema, pieces, raw_text, span_hashes, word_hashes
from citygeo.llm.near import open_blocks, star_links, tiles, with_texts

SEED = 42
TILE, TILE_SHINGLES = 2048, 1 << 18  # members of a tile, and their shingles; a longer text is a tile with few others
FEW = 8
MOST = 1_000_000  # rows of two numbers that may be broadcast
LANES, WORDS, BLOCK_BYTES = 1 << 19, 1 << 14, 4 << 20
BANDS, ROWS = 16, 3
EXTRA = (24, 34)  # powers of two of nodes beyond which parts grow by one each
STEP = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 0x20
_ORDERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _hashes(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(partial(xxh64_intdigest, seed=SEED), grams), np.uint64, len(words) - width + 1)


def majorities(hashes: np.ndarray, bounds: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Majority of each bit, strictly, of hashes[bounds[i]:bounds[i + 1]]; zero for none. Four bits are counted in one word, in
    16 bits each; step keeps these from running over."""
    sizes = np.diff(bounds)
    ones, owner = np.zeros((len(sizes), 4, 16), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), step):
        part, own = hashes[at : at + step], owner[at : at + step]
        first = np.flatnonzero(np.r_[True, np.diff(own) != 0])
        for k in range(16):
            count = np.add.reduceat((part >> np.uint64(k)) & np.uint64(0x0001000100010001), first)
            ones[own[first], :, k] += count.view("<u2").reshape(-1, 4)
    return np.packbits(2 * ones.reshape(-1, 64) > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _fingerprint_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = [_hashes((text or "").encode(), width) for text in piece.column(1).to_pylist()]
            bounds = np.cumsum([0, *map(len, found)])
            prints = majorities(np.concatenate(found), bounds).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(prints)], ["id", "key", "fp"])

    return run


def _keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (hash of the text) and fp (long) of each row of docs."""
    rows = _keyed_texts(docs, id_col, text_col)
    return rows.mapInArrow(_fingerprint_rows(shingle), out_schema(rows, "id", "key long, fp long"))


def shingle_table(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and where each text begins. A text of fewer words is one shingle."""
    data, offsets = raw_text(column)
    words = Words(_LOWER[data], offsets)
    per = np.diff(words.doc)
    grams = np.where(per >= width, per - width + 1, np.minimum(per, 1))
    owner = np.repeat(np.arange(len(per)), grams)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + words.doc[owner]
    hashes = span_hashes(word_hashes(words), start, np.minimum(start + width, words.doc[owner + 1]))
    ends = np.cumsum(grams)
    for lo, hi in zip((ends - grams).tolist(), ends.tolist()):
        hashes[lo:hi].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(per) + 1))


def _band_keys(distinct: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set and band a hash of ROWS least shingle hashes, each under an order of its own. No set may be empty."""
    if len(bounds) == 1:
        return np.zeros((0, BANDS), np.uint64)
    least = np.stack([np.minimum.reduceat(distinct * order, bounds[:-1]) for order in _ORDERS], axis=1)
    keys = np.broadcast_to(_ORDERS[:BANDS], (len(least), BANDS)).copy()
    for row in range(ROWS):
        keys = mix(keys ^ least[:, row * BANDS : (row + 1) * BANDS])
    return keys


def set_hashes(distinct: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return span_hashes(distinct, bounds[:-1], bounds[1:])


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            distinct, bounds = shingle_table(piece.column(1), width)
            full = np.flatnonzero(np.diff(bounds))
            keys = _band_keys(distinct, np.r_[bounds[full], len(distinct)]).view(np.int64)
            edge = np.r_[0, np.cumsum(np.where(np.diff(bounds) > 0, BANDS, 0))]
            size = pc.fill_null(pc.binary_length(piece.column(1)), 0).cast(pa.int64())
            bands = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(keys.ravel()))
            longs = [set_hashes(distinct, bounds), majorities(distinct, bounds), majorities(mix(distinct), bounds)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), size, pa.array(np.diff(bounds)), *(pa.array(c.view(np.int64)) for c in longs), bands], ["id", "key", "size", "n_shingles", "node", "s0", "s1", "bands"])

    return run


def shingle_sets(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (hash of the text), size (bytes), n_shingles, node (64-bit hash of the set of shingles), s0 and s1 (its sketch) and bands of each row."""
    rows = _keyed_texts(docs, id_col, text_col)
    return rows.mapInArrow(_set_rows(shingle), out_schema(rows, "id", "key long, size long, n_shingles long, node long, s0 long, s1 long, bands array<long>"))


def _part_blocks(fp: Column, radius: int, extra: int) -> Column:
    """Block ids of a fingerprint: a hash of the bits in each choice of extra + 1 of radius + 1 + extra parts."""
    n = radius + 1 + extra
    edge = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(fp, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)) for i in range(n)]
    return F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in which]) for k, which in enumerate(chosen(n, extra + 1))])


def _planes(fps: np.ndarray, spare: int) -> np.ndarray:
    """Bit planes of fingerprints (a row each), 64 lanes a word, with spare words behind."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    wide = np.zeros((bits.shape[1], ((n + 63) // 64 + spare) * 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _within(planes: np.ndarray, q: int, r: int, active: np.ndarray, radius: int) -> np.ndarray:
    """active has a row of lanes for each of the shifts 64 * q + r, 64 * (q + 1) + r, ...: those of them whose distance to
    the lane that much further on is at most radius."""
    levels = int(radius + 1).bit_length()
    start = (1 << levels) - (radius + 1)  # counters overflow at radius + 1
    full, none = np.full(active.shape, ~np.uint64(0)), np.zeros(active.shape, np.uint64)
    count = [(full if start >> k & 1 else none).copy() for k in range(levels)]
    over = none.copy()
    words, beyond = active.shape[1], q + sum(active.shape)

    def differ(plane: np.ndarray) -> np.ndarray:
        moved = plane[q : beyond - 1]
        if r:
            moved = (moved >> np.uint64(r)) | (plane[q + 1 : beyond] << np.uint64(64 - r))
        return plane[:words] ^ np.lib.stride_tricks.sliding_window_view(moved, words)

    def add(level: int, x: np.ndarray) -> None:
        nonlocal over
        for k in range(level, levels):
            x, count[k] = count[k] & x, count[k] ^ x
        over |= x

    for b in range(0, len(planes), 3):
        three = [differ(plane) for plane in planes[b : b + 3]]
        if len(three) == 3:
            odd = three[0] ^ three[1]
            add(1, (three[0] & three[1]) | (odd & three[2]))
            add(0, odd ^ three[2])
        else:
            for x in three:
                add(0, x)
        if b % 6 == 3 and not (active & ~over).any():
            return none
    return active & ~over


def spanning(fps: np.ndarray, group: np.ndarray, radius: int, confirm: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of links within the radius between fingerprints (a row each) of one group (sorted by group) that span all of
    them. With confirm, only pairs that it takes are links; all pairs within the radius are put to it, some shifts at a time,
    but for those that are joined already, by links found before or by label (for each place the first one of its part)."""
    a, b = [], []
    label = np.arange(len(fps)) if label is None else label.copy()

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def take(left: np.ndarray, right: np.ndarray) -> None:
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
        if confirm is not None and len(left):
            taken = confirm(left, right)
            left, right = left[taken], right[taken]
        for x, y in zip(left.tolist(), right.tolist()):
            p, q = root(x), root(y)
            if p != q:
                label[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        while len(left) and (label[label] != label).any():
            label[:] = label[label]

    own, sizes = np.arange(len(fps)), np.bincount(group, minlength=1)
    q = 0
    while True:
        own = own[sizes[group[own]] > max(64 * q, 1)]
        if not len(own):
            return np.array(a, np.int64), np.array(b, np.int64)
        words = (len(own) + 63) // 64
        shifts = min(max(1, WORDS // words), int(sizes[group[own]].max() - 1) // 64 + 1 - q) if q else 1
        planes = _planes(fps[own], q + shifts + 1)
        for r in range(0 if q else 1, 64):
            if not q and r > 1:  # small groups end here, one after the other
                left = own[sizes[group[own]] > r]
                if len(left) < 0.7 * len(own):
                    own, words = left, (len(left) + 63) // 64
                    if not len(own):
                        break
                    planes = _planes(fps[own], 2)
            active = np.zeros((shifts, words * 64), bool)
            for k in range(shifts):
                by = 64 * (q + k) + r
                if by < len(own):
                    active[k, : len(own) - by] = group[own[:-by]] == group[own[by:]]
            near = _within(planes, q, r, np.packbits(active, axis=1, bitorder="little").view(np.uint64), radius)
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                i = np.flatnonzero(np.unpackbits(near[k].view(np.uint8), bitorder="little"))
                take(own[i], own[i + 64 * (q + k) + r])
        q += shifts


def block_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints at both ends of the links that ``spanning`` finds."""
    a, b = spanning(fps[:, None], group, radius)
    return fps[a], fps[b]


def _whole_blocks(batches: Iterator[pa.RecordBatch], text_at: int | None = None, rows: int = LANES, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by block and tiles (the first columns), some whole blocks at a time, and the number of each row's block."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    last = None

    def numbered() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        block, tiles = table.column(0).to_numpy(), table.column(1).to_numpy()
        return table, np.cumsum(np.r_[0, (np.diff(block) != 0) | (np.diff(tiles) != 0)])

    for batch in batches if text_at is None else pieces(batches, text_at):
        if not batch.num_rows:
            continue
        block, tiles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.r_[last != (block[0], tiles[0]), (np.diff(block) != 0) | (np.diff(tiles) != 0)])
        last = block[-1], tiles[-1]
        if len(cut) and held and (count + batch.num_rows > rows or size > most):
            held += [batch.slice(0, cut[-1])] if cut[-1] else []
            yield numbered()
            held, count, size, batch = [], 0, 0, batch.slice(cut[-1])
        held.append(batch)
        count, size = count + batch.num_rows, size + batch.nbytes
    if held:
        yield numbered()


def _link_rows(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_blocks(batches):
            a, b = block_links(np.ascontiguousarray(table.column(2).to_numpy()).view(np.uint64), group, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _one_by_one(distinct: np.ndarray, bounds: np.ndarray, least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells of pairs of sets, by their numbers, whether their similarity is least or more. No set may be empty."""
    size = np.diff(bounds)

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for k in np.flatnonzero(np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y])).tolist():
            a, b = distinct[bounds[x[k]] : bounds[x[k] + 1]], distinct[bounds[y[k]] : bounds[y[k] + 1]]
            shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            out[k] = shared >= least * (len(a) + len(b) - shared)
        return out

    return alike


def _by_bits(distinct: np.ndarray, bounds: np.ndarray, least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The same for many pairs: a row of bits for each set, one bit for each member that other sets have too."""
    size = np.diff(bounds)
    _, back, times = np.unique(distinct, return_inverse=True, return_counts=True)
    common = times[back] > 1
    place = (np.cumsum(times > 1) - 1)[back[common]]
    rows = np.zeros((len(size), int((times > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(rows, (np.repeat(np.arange(len(size)), size)[common], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    step = max(1, STEP // rows.shape[1])

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for at in range(0, len(x), step):
            p, q = x[at : at + step], y[at : at + step]
            shared = np.bitwise_count(rows[p] & rows[q]).sum(axis=1, dtype=np.int64)
            out[at : at + step] = shared >= least * (size[p] + size[q] - shared)
        return out

    return alike


def _first_of_root(group: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each place the first one with the same group and root."""
    _, first, back = np.unique(np.column_stack([group, root]), axis=0, return_index=True, return_inverse=True)
    return first[back.ravel()]


def _sketches(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in ("s0", "s1")], axis=1).view(np.uint64)


def _near_rows(radius: int):
    """block, tile and node of the nodes that have one of another root within the radius in their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_blocks(batches):
            near = np.zeros(len(group), bool)

            def mark(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                near[x] = near[y] = True
                return np.zeros(len(x), bool)

            spanning(_sketches(table), group, radius, mark, _first_of_root(group, table.column("root").to_numpy()))
            yield from table.select(["block", "tile", "node"]).filter(pa.array(near)).combine_chunks().to_batches()

    return run


def _exact_link_rows(width: int, radius: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_blocks(batches, text_at=6):
            node = table.column("node").to_numpy()
            sets = [shingle_table(piece.column(0), width) for piece in pieces(iter(table.select(["text"]).to_batches()), 0)]
            distinct, bounds = np.concatenate([d for d, _ in sets]), np.r_[0, np.cumsum(np.concatenate([np.diff(b) for _, b in sets]))]
            edge = np.r_[np.flatnonzero(np.r_[True, np.diff(group) != 0]), len(group)]
            few = _one_by_one(distinct, bounds, least)
            many: dict[int, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {}

            def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                out, own = np.zeros(len(x), bool), group[x]
                large = np.diff(edge)[own] > FEW
                out[~large] = few(x[~large], y[~large])
                for k in np.unique(own[large]).tolist():
                    lo, hi, mine = edge[k], edge[k + 1], own == k
                    if k not in many:
                        many[k] = _by_bits(distinct[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], least)
                    out[mine] = many[k](x[mine] - lo, y[mine] - lo)
                return out

            a, b = spanning(_sketches(table), group, radius, alike, _first_of_root(group, table.column("root").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return run


def _tiled(keyed: DataFrame, node: str) -> DataFrame:
    """keyed (block, node, n tiles of the block, ...) with tiles: a number for each pair of tiles that the node is in."""
    dealt = keyed.withColumn("mine", F.pmod(F.xxhash64(node), "n").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    return dealt.withColumn("tiles", F.least("mine", "other").cast("long") * F.col("n") + F.greatest("mine", "other"))


def links(keyed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between nodes fp that share a block: keyed has distinct (block, fp)."""
    sizes = keyed.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n"), F.count("*").alias("size")).filter("size > 1")
    dealt = _tiled(keyed.join(sizes, "block"), "fp").select("block", "tiles", "fp").repartition("block", "tiles")
    return dealt.sortWithinPartitions("block", "tiles").mapInArrow(_link_rows(radius), "a long, b long")


def exact_links(docs: DataFrame, base: DataFrame, shingle: int, radius: int, least: float, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Links (a, b) between nodes of base (shingle_sets of docs) that share a block, have sketches within the radius, and have
    a similarity of ``least`` or more; they join all nodes that such pairs join.

    First each node is held against the least node of all its blocks, in stars. Blocks that this joins are done. The others are dealt
    into tiles, near by far and far by far; a pass over sketches picks the nodes with a partner in another component, and only
    these nodes' texts, one of each, are shuffled to their tiles. Up to ``most`` rows of such nodes (counted) are broadcast to pick
    the texts; beyond that docs are shuffled."""
    keyed = base.select("node", "bands").dropDuplicates(["node"]).select(F.explode("bands").alias("block"), "node")
    sizes = keyed.groupBy("block").agg(F.count("*").alias("size"), F.min("node").alias("head")).filter("size > 1")
    keyed = checkpoint(keyed.join(sizes, "block").select("block", "node", "head"))
    one = base.join(keyed.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("size", "id", "key", "s0", "s1", "n_shingles")).alias("one"))
    one = checkpoint(one.select("node", "one.s0", "one.s1", F.col("one.n_shingles").alias("n"), F.col("one.id").alias("one_id"), F.col("one.key").alias("one_key")))

    pairs = keyed.groupBy("node").agg(F.min("head").alias("head")).filter("head < node").join(one.select("node", "s0", "s1", "n"), "node")
    pairs = pairs.join(one.select(F.col("node").alias("head"), F.col("s0").alias("h0"), F.col("s1").alias("h1"), F.col("n").alias("h")), "head")
    unlike = F.bit_count(F.col("s0").bitwiseXOR(F.col("h0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("h1")))
    pairs = checkpoint(pairs.filter((unlike <= radius) & (F.least("n", "h") >= least * F.greatest("n", "h"))).select("head", "node", "n"))
    first = checkpoint(star_links(docs, pairs, one, partial(shingle_table, width=shingle), 100 * least, id_col, text_col, TILE, TILE_SHINGLES, most))

    joined = components(first).toDF("linked", "to")
    own = checkpoint(one.join(joined, F.col("node") == F.col("linked"), "left").select("node", "s0", "s1", "n", F.coalesce("to", "node").alias("root")))
    met = keyed.select("block", "node").join(own, "node")
    dealt = checkpoint(tiles(met.join(open_blocks(met), "block"), TILE, TILE_SHINGLES).select("block", "tile", "node", "s0", "s1", "root"))
    dealt = dealt.repartition("block", "tile").sortWithinPartitions("block", "tile")
    wanted = checkpoint(dealt.mapInArrow(_near_rows(radius), "block long, tile long, node long"))
    rows = with_texts(docs, wanted.join(own.drop("n"), "node"), one, id_col, text_col, most).select("block", "tile", "node", "s0", "s1", "root", "text")
    rows = rows.repartition("block", "tile").sortWithinPartitions("block", "tile")
    return first.unionByName(rows.mapInArrow(_exact_link_rows(shingle, radius, least), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the least node reachable. Large-star and small-star rounds."""
    edges = checkpoint(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = checkpoint(small.select("e.*").filter("a != b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select("b", "b").distinct())


def near_groups(docs: DataFrame, shingle: int = 5, radius: int = 44, blocks: str = "shingles", id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """Per row of docs: id, fingerprint (16 hex digits), component_id (least id reachable over links, its own included), text_key
    (64-bit hash of the text) and root (a number that all rows of a component share).

    With ``blocks="parts"`` two documents are linked if their fingerprints differ in at most ``radius`` bits. With
    ``blocks="shingles"`` they are linked if the similarity of their shingle sets is ``least`` or more, exactly; a pair is looked at
    if it shares a band and its sketches of 128 bits differ in at most ``radius`` bits. At a similarity of 0.8 a pair shares no
    band with a chance of (1 - 0.8 ** ROWS) ** BANDS, and sketches differ in 19 bits on average (deviation 4).

    Letters A-Z are lowered. A text with fewer words than a shingle counts as one shingle; null, empty and wordless texts have
    fingerprint zero and are one group. Rows with null ids are grouped too; component_id is null only if all ids of a component
    are. Repeated rows stay, ids may repeat. Other columns of docs are not read.
    """
    if blocks == "shingles":
        base = checkpoint(shingle_sets(docs, shingle, id_col, text_col))
        nodes = components(exact_links(docs, base, shingle, radius, least, id_col, text_col)).withColumnRenamed("node", "linked")
        base = base.select("id", "key", F.col("s0").alias("fp"), "node")
    else:
        base = checkpoint(fingerprints(docs, shingle, id_col, text_col))
        n = base.agg(F.approx_count_distinct("fp")).first()[0]
        extra = sum(n > 1 << k for k in EXTRA)
        keyed = base.select("fp").distinct().select(F.explode(_part_blocks(F.col("fp"), radius, extra)).alias("block"), "fp")
        nodes = components(links(keyed, radius)).withColumnRenamed("node", "linked")
        base = base.select("id", "key", "fp", F.col("fp").alias("node"))
    named = base.groupBy("node").agg(F.min("id").alias("least")).join(nodes, F.col("node") == F.col("linked"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select("node", "root", "component_id")
    out = base.join(named, "node")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("key").alias("text_key"), "root")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row of docs for each component of groups (near_groups of docs): that with the least id, null ids last, then the least
    hash of its text. Rows are told apart by id and text, so rows with equal ids and other texts are not lost; of rows equal in
    both, one stays. Up to ``most`` rows that go or repeat (counted) are broadcast, so that documents are not shuffled; beyond
    that the join shuffles. Columns of docs may have any names."""
    rank = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.col("text_key").alias("key")).alias("rank")
    own = groups.groupBy("root", rank).agg(F.count("*").alias("n"))
    first = own.groupBy("root").agg(F.min("rank").alias("first"))
    own = own.join(first, "root").select(F.col("rank.id").alias("own_id"), F.col("rank.key").alias("own_key"), (F.col("rank") == F.col("first")).alias("stays"), "n")
    own = checkpoint(own.filter("not stays or n > 1").drop("n"))
    few = own.count() <= most
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    same = (F.col("key") == F.col("own_key")) & F.col("id").eqNullSafe(F.col("own_id"))
    meet = lambda part, how: rows.join(F.broadcast(part) if few else part, same, how)
    kept, repeated = meet(own, "left_anti"), meet(own.filter("stays"), "left_semi").dropDuplicates(["key", "id"])
    return kept.unionByName(repeated).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), shingle=3, radius=2, blocks="parts").select("doc_id", "fingerprint", "component_id")
