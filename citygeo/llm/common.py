"""What the text operators share: Arrow batches as numpy word tables, 64-bit hashes, lineage cuts.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout. All separators are ASCII, so the bytes of UTF-8 text can be cut
without decoding, and ``bytes.split()`` cuts at the same places. A null text has no words.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
MOST_PARTS = 100_000  # rows of partitions and groups that may be broadcast
PIECE_BYTES = 1 << 20  # numbers of 64 bits that stand for each byte for a while make this about 100 MB of a worker
_ODD = 0x9E3779B97F4A7C15
_LIBC = ctypes.CDLL(None)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is set, a local session gets a temporary one; others are told."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows, cut from their lineage in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def out_schema(df: DataFrame, id_col: str, fields: str) -> StructType:
    """The id column as it is in df, then fields (DDL)."""
    rest = StructType.fromDDL(fields)
    return StructType([StructField(id_col, df.schema[id_col].dataType, True), *rest.fields])


def pieces(batches: Iterator[pa.RecordBatch], text_at: int = 1, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text column of each holds about ``most`` bytes; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    tidy()


def tidy() -> None:
    """Gives memory that a task no longer uses back to the system; workers live on, and else keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more than texts). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of some texts: byte spans ``start``/``end``, and ``doc`` bounds (word index at which each text begins)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~GAP[data] if len(data) else np.zeros(0, bool)
        begins, ends = solid.copy(), solid.copy()
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        if len(data):
            joined = solid[1:] & solid[:-1]
            joined[edge - 1] = False
            begins[1:] &= ~joined
            ends[:-1] &= ~joined
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)


def powers(n: int, odd: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """odd**i and its inverse modulo 2**64, for i below n at least."""
    have = _powers.get(odd)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = []
        for base in (odd, pow(odd, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[odd] = tuple(out)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, odd: int = _ODD) -> np.ndarray:
    """64-bit hashes of values[start:end] for many spans at once: equal spans have equal hashes wherever they stand."""
    up, down = powers(len(values) + 1, odd)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ mix((end - start).astype(np.uint64)))


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.start, words.end)


def chosen(n: int, k: int) -> list[tuple[int, ...]]:
    return list(combinations(range(n), k))


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; sets how many groups an operator deals documents into."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, ...) with rank (from 0) and n (rows) within grp, ordered by the columns of order, nulls first; equal rows anyhow.

    Rows are range-partitioned by all of these and by their place, so equal rows and rows of one group are spread too. A rank is the place
    in the partition and the rows of the group in the partitions before: no window holds a group.
    """
    by = [F.col(c).asc_nulls_first() for c in ["grp", *order, "place"]]
    rows = checkpoint(rows.withColumn("place", F.monotonically_increasing_id()))
    rows = checkpoint(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).alias("part")
    parts = rows.groupBy(F.col("grp").alias("of"), part).agg(F.count("*").alias("own"), F.min("place").alias("first"))
    whole = Window.partitionBy("of")
    before = F.sum("own").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = checkpoint(parts.select("of", F.col("part").alias("there"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("own").over(whole).alias("n")))
    if parts.count() <= MOST_PARTS:
        parts = F.broadcast(parts)
    met = rows.join(parts, (part == F.col("there")) & F.col("grp").eqNullSafe(F.col("of")))
    return met.withColumn("rank", F.col("place") + F.col("shift")).drop("place", "of", "there", "shift")
