"""Product codes of vectors with equal-average search.

Vectors become whole numbers and are cut into parts; each part position has a codebook of up to ENTRIES entries, which a fixed
number of rounds moves to the floor of the mean of the parts nearest to them.

Nearest entries: the squared difference of two component sums, over the number of components, is at most the squared distance.
Entries are sorted by sum, and each part starts at its own sum and goes outward, to the nearer side first; it stops when the squared
gap over the dimension strictly exceeds its best distance, so ties are all seen. All parts of a batch go outward together, a step at
a time, and those that have stopped leave.

A round is one pass: tasks hold sums and counts of each entry alone, these are added in Spark, and the driver gets one row for each
entry. Codebooks are all that travels with the closure; their size is ENTRIES times the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import checkpoint, out_schema

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
MOST = 1_000_000  # rows of a label and a number that may be broadcast
ROWS = 4096
FAR, TOP = 1 << 40, np.iinfo(np.int64).max


def search(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of the entry of book nearest to each row of values (whole numbers); ties go to the lower place."""
    width = max(values.shape[1], 1)
    own = book.sum(axis=1)
    order = np.argsort(own, kind="stable")
    sums = np.r_[-FAR, own[order], FAR]  # a bound at either end
    order = np.r_[0, order, 0]
    place, best = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    rows, x, s = np.arange(len(values)), values, values.sum(axis=1)
    right = np.searchsorted(sums, s)
    left = right - 1
    code, least = np.zeros(len(rows), np.int64), np.full(len(rows), TOP)
    while len(rows):
        down, up = s - sums[left], sums[right] - s
        below = down <= up
        gap = np.where(below, down, up)
        goes = (gap < FAR // 2) & ((least == TOP) | (gap * gap <= least * width))
        if not goes.all():
            stops = ~goes
            place[rows[stops]], best[rows[stops]] = code[stops], least[stops]
            rows, x, s, left, right, code, least, below = (a[goes] for a in (rows, x, s, left, right, code, least, below))
            if not len(rows):
                break
        entry = order[np.where(below, left, right)]
        away = np.square(x - book[entry]).sum(axis=1)
        better = (away < least) | ((away == least) & (entry < code))
        code, least = np.where(better, entry, code), np.where(better, away, least)
        left, right = left - below, right + ~below
    return place, best


def limit(width: int) -> int:
    """Greatest component with which squared sums over parts of that width fit in 64 bits."""
    return min(1 << 28, (1 << 30) // max(width, 1))


def _numbers(column: pa.Array, dim: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is kept, and their components as whole numbers (padded with zeros to dim)."""
    column = column.cast(pa.large_list(pa.float64()))
    flat, size = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    owner = np.repeat(np.arange(len(column)), size)
    x = flat.to_numpy(zero_copy_only=False)
    kept = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    kept[owner[~np.isfinite(x)]] = False  # nulls are NaN here
    out = np.zeros((len(column), dim), np.int64)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    good = kept[owner]
    scaled = np.floor(SCALE * x[good])
    if len(scaled) and (abs(scaled) > most).any():
        raise ValueError(f"components beyond {most // SCALE} have no place in 64-bit sums; scale the vectors first")
    out[owner[good], at[good]] = scaled.astype(np.int64)
    rows = np.flatnonzero(kept)
    return rows, out[rows]


def _batches(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    parts, _, width = books.shape
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, *_numbers(piece.column(0), parts * width, limit(width))


def _sum_rows(books: np.ndarray):
    """One row for each part and entry that a task has met: count, and the sum of each component."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, _, x in _batches(batches, books):
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                code, _ = search(own, books[p])
                count[p] += np.bincount(code, minlength=entries)
                np.add.at(total[p], code, own)
        p, e = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), sums], ["part", "entry", "count", "sums"])

    return run


def _code_rows(books: np.ndarray, names: list[str]):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows, x in _batches(batches, books):
            found = [search(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
            error = np.sum([least for _, least in found], axis=0, dtype=np.int64)
            text = codes.tobytes().hex()
            kept = piece.select(range(1, piece.num_columns)).take(pa.array(rows))
            code = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([*kept.columns, code, pa.array(error)], names)

    return run


def _kept(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows of vectors whose vector has finite components only."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))


def first_books(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Parts of the vectors with the least ids as codebooks (part, entry, component), null ids last, equal ids by their vectors."""
    dim = _kept(vectors, vector_col).agg(F.max(F.size(vector_col))).first()[0] or 0
    dim = -(-dim // parts) * parts
    first = _kept(vectors, vector_col).select(F.col(vector_col).alias("v"), F.col(id_col).alias("id")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries)
    table = first.toArrow()  # entries rows at most
    _, x = _numbers(table.column("v").combine_chunks(), dim, limit(dim // parts)) if table.num_rows else (None, np.zeros((0, dim), np.int64))
    return np.ascontiguousarray(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2))


def fit_books(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS, vector_col: str = "embedding") -> np.ndarray:
    """books after some rounds of moving each entry to the floored mean of the parts nearest to it; unused entries stay."""
    parts, entries, width = books.shape
    for _ in range(rounds if entries and width else 0):
        sums = vectors.select(vector_col).mapInArrow(_sum_rows(books), "part int, entry int, count long, sums array<long>")
        added = sums.groupBy("part", "entry").agg(F.sum("count").alias("count"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        books = books.copy()
        for row in added.collect():  # parts * entries rows at most
            books[row["part"], row["entry"]] = np.array(row["sums"], np.int64) // row["count"]
    return books


def encode(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", *carry: str) -> DataFrame:
    """id, the columns to carry, code (two hex digits a part) and error (squared distances of its parts to their entries, added up)."""
    rows = vectors.select(F.col(vector_col).alias("v"), F.col(id_col).alias("k0"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(carry, 1)])
    schema = out_schema(rows, "k0", "code string, error long")
    for k in range(len(carry), 0, -1):
        schema.fields.insert(1, rows.schema[f"k{k}"])
        schema.names.insert(1, f"k{k}")
    if not books.shape[1]:
        return rows.drop("v").limit(0).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).toDF(id_col, *carry, "code", "error")
    return rows.mapInArrow(_code_rows(books, schema.fieldNames()), schema).toDF(id_col, *carry, "code", "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Per kept row of vectors: id, label, code, error and label_error (errors of rows with that label, nulls together); and the codebooks.

    Rows whose vector is null or has null or non-finite components are dropped; the others stay, repeated ones and those with null or
    equal ids as well. Components become floor(1024 * x); beyond ``limit`` (65,536 for 64 dimensions) they are refused,
    as sums of squares would not fit 64 bits. Vectors of
    different lengths count as padded with zeros at the end to the longest, and this to a multiple of ``parts``. With fewer kept
    rows than ``entries`` codebooks are that much shorter. An empty table gives no rows and empty codebooks. Columns of vectors that
    are not named here are not read and may have any names.
    """
    books = fit_books(vectors, first_books(vectors, id_col, vector_col, parts, entries), rounds, vector_col)
    found = checkpoint(encode(vectors, books, id_col, vector_col, label_col).toDF("id", "label", "code", "error"))
    total = checkpoint(found.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")))
    if total.count() <= MOST:
        total = F.broadcast(total)
    met = found.join(total, F.col("label").eqNullSafe(F.col("own")))
    return met.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def books_digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql_nearest(book: str) -> str:
    return f"""select r, part, v, arg_min(entry, (away, entry)) as entry, min(away) as away from (select p.r, p.part, p.v, b.entry,
      list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as away from parts p join {book} b on b.part = p.part) group by r, part, v"""


def _sql_round(k: int) -> str:
    return f"""near{k} as materialized ({_sql_nearest(f"book{k}")}),
moved{k} as (select part, entry, list(cast(floor(s / n) as bigint) order by i) as v from (select part, entry, i, sum(c) as s, count(*) as n
  from (select part, entry, unnest(v) as c, unnest(range(1, len(v) + 1)) as i from near{k}) group by part, entry, i) group by part, entry),
book{k + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from book{k} b left join moved{k} m on m.part = b.part and m.entry = b.entry),"""


ORACLE = f"""
with kept as materialized (select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select r, g.p as part, list_slice(x, g.p * len(x) // {PARTS} + 1, (g.p + 1) * len(x) // {PARTS}) as v from kept, range({PARTS}) g(p)),
book0 as materialized (select part, r as entry, v from parts where r < {ENTRIES}),
{"".join(_sql_round(k) for k in range(ROUNDS))}
last as ({_sql_nearest(f"book{ROUNDS}")}),
codes as (select r, string_agg(printf('%02x', entry), '' order by part) as code, sum(away) as error from last group by r),
digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as d from book{ROUNDS})
select vec_id, code, cast(error as bigint) as error, cast(sum(error) over (partition by label) as bigint) as label_error, d as codebooks_sha256
from kept join codes using (r) cross join digest
"""
