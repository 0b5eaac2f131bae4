"""Checks of walls: told from faces as from vertices, and without moving either."""

from pyspark.sql import functions as F

from citygeo.operators import mesh as M
from citygeo.operators.spatial import dealt
from citygeo.plans import place_queries
from citygeo.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
# A square, a low hall, a line there and back (whose walls lie on each other), a ring walked twice, and one without walls.
RINGS = [
    (1, [(0.0, 0.0), (7.0, 0.0), (7.0, 7.0), (0.0, 7.0)], 9.0),
    (2, [(0.0, 0.0), (40.0, 0.0), (40.0, 3.0), (0.0, 3.0)], 3.0),
    (3, [(0.0, 0.0), (6.0, 0.0), (12.0, 0.0), (6.0, 0.0)], 12.5),
    (4, [(0.0, 0.0), (6.0, 0.0), (0.0, 6.0), (0.0, 0.0), (6.0, 0.0), (0.0, 6.0)], 0.2),
    (5, [(0.0, 0.0), (0.01, 0.0), (0.0, 0.01)], 9.0),
]


def rings(spark):
    return spark.createDataFrame(RINGS, "node_id long, points array<struct<x: double, y: double>>, height_m double")


def told(df):
    return {r.mesh_id: (r.edges, r.open_edges, r.crowded_edges, round(r.area_m2, 6)) for r in df.collect()}


def test_faces_tell_what_vertices_do(spark):
    own = rings(spark)
    mesh = M.quad_mesh(M.wall_quads(M.facade_bays(own.drop("height_m")), own.select("node_id", "height_m")))
    found = told(M.face_checks(M.quad_faces(M.wall_quads(M.facade_bays(own)))))
    assert found == told(M.mesh_closure(*mesh).join(M.mesh_area(*mesh), "mesh_id"))
    assert sorted(found) == [1, 2, 3, 4] and found[1][:3] == (8 * 7, 16, 0) and found[3][2] > 0 and found[4][2] > 0
    assert found[2][3] == 86 * 3.0


def test_only_rings_are_moved(spark):
    own = QUERIES["wall_checks"](spark, FOLDER)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    moved = own._jdf.queryExecution().executedPlan().toString()
    assert moved.count("Exchange") == 1 and "Exchange hashpartitioning(node_id" in moved


def test_parts_of_meshes_are_small(spark):
    own = dealt(place_queries.rings(spark, FOLDER), 3, "node_id")
    assert own.rdd.getNumPartitions() == own.count() // 3 + 1
    assert dealt(own, 10**6, "node_id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = M.face_checks(M.quad_faces(place_queries.wall_quads(place_queries.rings(spark, FOLDER))))
    assert told(M.face_checks(M.quad_faces(place_queries.wall_quads(own)))) == told(whole)


def test_walls_of_no_buildings(spark, tmp_path):
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES["wall_checks"](spark, str(tmp_path)).count() == 0
