"""Equi-joins on grid cells in place of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Boxes up to WIDE fine cells a side are met on fine cells (degrees), larger ones on coarse cells: 16,200 cover the world.
FINE_DEG, WIDE, COARSE_DEG = 0.01, 25, 2.0
MOST_TOGETHER = 1000  # values of a key in one array
MOST_FEW = 1_000_000  # rows that may be broadcast


def cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("long")


def box_cells(df: DataFrame, min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, lat_size: Column | float, lon_size: Column | float) -> DataFrame:
    """A row for each cell (_row, _col) that a box touches."""
    rows = df.withColumn("_row", F.explode(F.sequence(cell(min_lat, lat_size), cell(max_lat, lat_size))))
    return rows.withColumn("_col", F.explode(F.sequence(cell(min_lon, lon_size), cell(max_lon, lon_size))))


def gathered(df: DataFrame, keys: list[str], value: str, most: int = MOST_TOGETHER) -> DataFrame:
    """keys and ids: the values of each key in arrays of about ``most``. Keys are counted first, and only those with more values
    are dealt, by a hash of the value, so no group lies in one task however large it is."""
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    same = [F.col(f"_own.{k}").eqNullSafe(F.col(f"_large.{k}")) for k in keys]
    dealt = df.alias("_own").join(large.alias("_large"), same, "left").select("_own.*", F.coalesce(F.pmod(F.xxhash64(f"_own.{value}"), F.ceil(F.col("_n") / most)), F.lit(0)).alias("_chunk"))
    return dealt.groupBy(*keys, "_chunk").agg(F.collect_list(value).alias("ids")).drop("_chunk")


def few(df: DataFrame, most: int = MOST_FEW) -> DataFrame:
    """The same rows, broadcast to those who join them if a count finds them few. df: kept, or made of a kept frame row by row."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that become many each, dealt over all shuffle partitions: small as they are, they are not put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """Rows by keys in parts of about ``most``, and as many parts as there are shuffle partitions at least: what is grouped by these
    keys, or by more, is then grouped within its part, which holds no more however many rows there are. df: kept, or made of a kept frame row by row."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // most + 1), *keys)


def is_wide(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, fine: float = FINE_DEG) -> Column:
    return F.greatest(max_lat - min_lat, max_lon - min_lon) > WIDE * fine


def place_cells(lat: Column, lon: Column, fine: float = FINE_DEG) -> Column:
    """array of a place's fine and coarse cell: struct(size, row, col)."""
    return F.array(*[F.struct(F.lit(size).alias("size"), cell(lat, size).alias("row"), cell(lon, size).alias("col")) for size in (fine, COARSE_DEG)])


def sized_cells(df: DataFrame, min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, fine: float = FINE_DEG) -> DataFrame:
    """A row for each cell (_size, _row, _col) that a box touches: fine cells, or coarse ones if it is wide."""
    sized = df.withColumn("_size", F.when(is_wide(min_lat, min_lon, max_lat, max_lon, fine), COARSE_DEG).otherwise(fine))
    return box_cells(sized, min_lat, min_lon, max_lat, max_lon, F.col("_size"), F.col("_size"))


def segment_cells(df: DataFrame, a: Column, b: Column, lat_size: float, lon_size: float) -> DataFrame:
    """A row for each cell that a segment a-b crosses: exact for each row of cells, from the longitudes it has there."""
    low, high = F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])
    rows = df.withColumn("_row", F.explode(F.sequence(cell(low, lat_size), cell(high, lat_size))))
    from_lat, to_lat = F.greatest(low, F.col("_row") * lat_size), F.least(high, (F.col("_row") + 1) * lat_size)
    at = lambda lat: a["lon"] + (b["lon"] - a["lon"]) * F.coalesce(F.try_divide(lat - a["lat"], b["lat"] - a["lat"]), F.lit(0.0))
    flat = a["lat"] == b["lat"]
    x = F.when(flat, F.least(a["lon"], b["lon"])).otherwise(F.least(at(from_lat), at(to_lat)))
    y = F.when(flat, F.greatest(a["lon"], b["lon"])).otherwise(F.greatest(at(from_lat), at(to_lat)))
    return rows.withColumn("_col", F.explode(F.sequence(cell(x, lon_size), cell(y, lon_size))))


def around(df: DataFrame, lat: Column, lon: Column, lat_size: float, lon_size: float) -> DataFrame:
    """Nine rows for each point: its cell and the eight about it."""
    near = F.sequence(F.lit(-1), F.lit(1))
    rows = df.withColumn("_row", F.explode(F.transform(near, lambda d: cell(lat, lat_size) + d)))
    return rows.withColumn("_col", F.explode(F.transform(near, lambda d: cell(lon, lon_size) + d)))
