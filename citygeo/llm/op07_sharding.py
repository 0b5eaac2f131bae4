"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A key's place on the ring is a hash of it; the ring has CELLS cells, and each shard owns the cells up to its virtual
nodes. Keys arrive clockwise. A key goes to its own shard, or, where that is full, to the next virtual node clockwise whose
shard has room. The capacities are the total dealt evenly (the first shards one more), so counts end at most one apart and
only the surplus of a shard moves.

All keys of a cell meet the same nodes, so the walk needs only the count of each cell: at most CELLS numbers, on the driver.
It returns, for each cell, runs of ranks with their shard and first slot, and every row is matched with its run. The
exchanges carry ids, sizes and checksums, not texts. Ranks within a cell are told over a range-partitioned table, so a cell, or rows
equal in all that is known of them, may be of any size.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from citygeo.llm.common import documents, ranked

CELLS = 1 << 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in clockwise order. A node's place depends on its shard and number alone."""
    nodes = {}
    for s in range(shards):
        for v in range(vnodes):
            nodes.setdefault(int(md5(f"{s}/{v}".encode()).hexdigest()[:8], 16) % CELLS, s)
    return sorted(nodes.items())


def walk(counts: dict[int, int], shards: int, vnodes: int) -> list[tuple[int, int, int, int, int, int]]:
    """cell, first rank, last rank + 1, shard, slot of the first, own shard."""
    nodes, total = ring(shards, vnodes), sum(counts.values())
    at = [cell for cell, _ in nodes]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot, runs = [0] * shards, []
    for cell in sorted(counts):
        left, rank = counts[cell], 0
        i = home = bisect_left(at, cell) % len(nodes)
        while left:
            s = nodes[i][1]
            if take := min(left, room[s]):
                runs.append((cell, rank, rank + take, s, slot[s], nodes[home][1]))
                room[s] -= take
                slot[s] += take
                rank += take
                left -= take
            i = (i + 1) % len(nodes)
    return runs


def shard_bounded(docs: DataFrame, shards: int = 8, vnodes: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, size (UTF-8 bytes of the text + 1; null: 1), text_crc32 (null text: that of no bytes), shard,
    slot (gapless from 0 in each shard) and home_shard (where the ring alone would put it).

    A row's key is its id with checksum and size, so that rows with equal or null ids do not share a place; rows equal in all
    three are interchangeable. Shard counts differ by one at most. Other columns of docs are not read. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    place = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), size, crc), F.lit(1 << 40))
    cell = F.shiftright(place, 24).cast("int")
    fields = [StructField("cell", IntegerType()), *[StructField(n, LongType()) for n in ("first", "beyond")], StructField("shard", IntegerType()), StructField("first_slot", LongType()), StructField("home_shard", IntegerType())]
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), place.alias("spot"), cell.alias("grp"))
    rows = ranked(rows, ["spot", "id", "text_crc32", "size"])
    counts = {r.grp: r.n for r in rows.groupBy("grp").agg(F.first("n").alias("n")).collect()}  # CELLS rows at most
    runs = F.broadcast(spark.createDataFrame(walk(counts, shards, vnodes), StructType(fields)))  # CELLS + shards * shards * vnodes rows at most
    dealt = rows.join(runs, (F.col("grp") == F.col("cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
    slot = (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot")
    return dealt.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot, "home_shard")


def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_bounded(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
