"""Registered queries against their SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from citygeo.plans import map_queries, world_queries
from citygeo.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def nodes_once(spark):
    """Graph nodes are made once here; each query makes its own elsewhere."""
    made = map_queries.nodes(spark, FOLDER)
    with pytest.MonkeyPatch.context() as patch:
        for module in (map_queries, world_queries):
            patch.setattr(module, "nodes", lambda *_: made)
        yield


def plain(v):
    if v is None or v != v:
        return None
    return int(v) if isinstance(v, float) and math.isfinite(v) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    own = QUERIES[name](spark, FOLDER)
    columns = sorted(own.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in own.collect()), key=str)
    there = duck.sql(ORACLES[name])
    assert columns == sorted(there.columns)
    at = [there.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in there.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_return_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
