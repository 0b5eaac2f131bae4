"""Terrain queries over more parts than one tile holds."""

import math
import os

import duckdb
import pytest

from citygeo.plans import world_queries as W

FOLDER = "/root/testdata/sf0.001"
PARTS = 6050  # two whole tiles, and 21 rows of a third


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tiles"))
    for name in ("orders", "lineitem"):
        os.symlink(f"{FOLDER}/{name}.parquet", f"{out}/{name}.parquet")
    spark.range(1, PARTS + 1).withColumnRenamed("id", "p_partkey").write.parquet(f"{out}/part.parquet")
    return out


@pytest.mark.parametrize("name", ["dem_statistics", "sample_elevation"])
def test_sql_states_all_tiles(spark, folder, name):
    con = duckdb.connect()
    for table in ("orders", "part"):
        path = f"{folder}/{table}.parquet"
        con.sql(f"create view {table} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    own = W.QUERIES[name](spark, folder)
    there = con.sql(W.ORACLES[name])
    at = [there.columns.index(c) for c in own.columns]
    assert sorted(map(tuple, own.collect())) == sorted(tuple(r[i] for i in at) for r in there.fetchall())


def elevation(line, col):
    return None if (line * 31 + col) % 97 == 0 else 900.0 + (line * 7 + col * 13) % 40


def test_statistics_count_every_part(spark, folder):
    values = [elevation((k - 1) // 50, (k - 1) % 50) for k in range(1, PARTS + 1)]
    known = [v for v in values if v is not None]
    assert tuple(W.dem_statistics(spark, folder).first()) == (PARTS, min(known), max(known), values.count(None))


def test_points_lie_on_all_tiles(spark, folder):
    got = {r.point_id: r.elev_mm for r in W.sample_elevation(spark, folder).collect()}
    keys = [r[0] for r in spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey").collect()]
    assert sorted(got) == sorted(keys)
    inside = 0
    for k in keys:
        if k * 37 % 1600 % 30 == 15 or k * 53 % 1600 % 30 == 15:
            continue  # on a pixel's centre, where rounding decides which four are met
        tile = k // 101 % 3
        height = 50 if tile < 2 else 21
        row, col = (k * 37 % 1600) / 30 - 0.5, (k * 53 % 1600) / 30 - 0.5
        want = -1.0
        if 0 <= row <= height - 1 and 0 <= col <= 49:
            r, c = math.floor(row), math.floor(col)
            four = [(elevation(tile * 50 + min(r + i, height - 1), min(c + j, 49)), abs(1 - i - row + r) * abs(1 - j - col + c)) for i in (0, 1) for j in (0, 1)]
            known = [v for v, _ in four if v is not None]
            mean = sum(known) / len(known)
            want = sum(w * (mean if v is None else v) for v, w in four)
            inside += tile > 0
        assert abs(got[k] - want * 1000) <= 1
    assert inside > 100


def test_terrain_points_lie_on_all_tiles(spark, folder):
    rows = W.terrain_heights(spark, folder).collect()
    assert len({r.point_id for r in rows}) == len(rows) and {r.point_id // 1_000_000 for r in rows} == {0, 1, 2}
    assert all(any(r.height_um > 0 for r in rows if r.point_id // 1_000_000 == t) for t in range(3))
