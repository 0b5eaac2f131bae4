"""What the queries over large tables do not do: resolve ways of other types, gather points, join nodes again, or make points twice."""


import pytest
from pyspark.sql import functions as F

from citygeo.operators import assets as A
from citygeo.operators import features as C
from citygeo.operators import graph as G
from citygeo.operators import mesh as M
from citygeo.operators import terrain as E
from citygeo.plans import map_queries
from citygeo.plans.map_queries import choices
from citygeo.plans.registry import QUERIES
from citygeo.sources import lens

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def places(df):
    return {tuple(r) for r in df.collect()}


def test_listed_nodes_are_those_of_the_graph(spark):
    columns = ["region_key", "node_id", "node_type", "subtype", "name", "osm_id", "is_area", F.to_json("flags")]
    own = map_queries.nodes(spark, FOLDER).filter("osm_id <> 0").select(*columns)
    listed = map_queries.listed(spark, FOLDER)
    assert places(listed.filter("osm_id <> 0").select(*columns)) == places(own) and listed.count() == listed.select("node_id").distinct().count()


def test_twins_without_shapes_keep_ids_of_their_own(spark):
    rows = [(7, "Building", "yes", True, 4, "", False), (7, "Building", "yes", True, 4, "", False), (7, "Building", "house", True, 5, "", True), (None, "Barrier", "fence", False, 2, "", False), (None, "Barrier", "fence", False, 2, "", False)]
    own = spark.createDataFrame(rows, "osm_id long, feature_type string, subtype string, is_area boolean, n_points long, name string, partial boolean").withColumn("region_key", F.lit("r"))
    found = G.list_nodes(own).collect()
    assert len(found) == 5 and len({r.node_id for r in found}) == 5
    assert sorted((r.osm_id, r.subtype, len(r.flags)) for r in found) == [(0, "fence", 0), (0, "fence", 0), (7, "house", 1), (7, "yes", 0), (7, "yes", 0)]


def test_nodes_of_a_kind_resolve_no_other_ways(spark):
    columns = ["node_id", "osm_id", F.to_json("points"), F.to_json("tags"), "metrics.height_m"]
    assert places(map_queries.nodes(spark, FOLDER, ["Building"]).select(*columns)) == places(map_queries.nodes(spark, FOLDER).filter("node_type = 'Building'").select(*columns))
    tags = lens.way_tags(spark, FOLDER)
    wanted = places(C.typed_ways(tags, ["Building"]).select("way_id"))
    assert places(lens.way_nodes(spark, FOLDER, C.typed_ways(tags, ["Building"])).select("way_id").distinct()) == wanted


def test_states_count_what_resolving_gathers(spark):
    ways = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 5), (2, 0, 6), (2, 1, 9), (3, 0, 9)], "way_id long, seq long, node_id long")
    nodes = spark.createDataFrame([(5, 1.0, 1.0), (6, 2.0, 2.0)], "id long, lat double, lon double")
    full = C.resolve_ways(ways, nodes).select("way_id", F.size("points").cast("long"), "n_refs", "n_missing", "closed")
    assert places(C.way_states(ways, nodes)) == places(full)


@pytest.mark.parametrize("most", [10, 0])
def test_corridors_are_names_of_two_roads_in_a_region(spark, most):
    rows = [("a", 1, "RoadSegment", "x"), ("a", 2, "RoadSegment", "x"), ("b", 3, "RoadSegment", "x"), ("a", 4, "Building", "x"), ("a", 5, "RoadSegment", ""), ("a", 6, "RoadSegment", "")]
    own = spark.createDataFrame(rows, "region_key string, node_id long, node_type string, name string")
    found = {r.node_id: r.corridor for r in G.with_corridors(own, most).collect()}
    assert found == {1: "x", 2: "x", 3: None, 4: None, 5: None, 6: None}


def test_choices_neither_group_nor_join_the_rows_again(spark):
    wanted = spark.range(100).select((F.col("id") % 7).cast("int").alias("rule_id"), F.lit(11).cast("long").alias("seed"), "id", F.col("id").alias("key"))
    picked = A.pick_choice(wanted, choices(spark))
    assert plan_of(picked).count("Range (0, 100") == 1 and picked.count() == 100
    assert all((r.idx is None) == (r.rule_id in (0, 5, 6)) for r in picked.collect())


def test_points_are_read_once_for_their_heights(spark):
    frame = spark.createDataFrame([("r", 0.0, 0.0, 10.0, 10.0, 2, 2)], "region_key string, min_x double, min_y double, step_x double, step_y double, div_x int, div_y int")
    grid = spark.createDataFrame([("r", x, y, 100.0 * x + 10.0 * y) for x in range(3) for y in range(3) if (x, y) != (2, 2)], "region_key string, ix int, iy int, height_cm double")
    points = spark.range(4).select(F.lit("r").alias("region_key"), "id", (F.col("id") * 5.0).alias("x_m"), F.lit(5.0).alias("y_m"))
    found = E.terrain_height(points, frame, grid)
    assert plan_of(found).count("Range (0, 4") == 1
    assert {r.id: round(r.height_cm, 6) for r in found.collect()} == {0: 5.0, 1: 55.0, 2: 105.0, 3: 155.0}
    assert E.terrain_height(points.withColumn("region_key", F.lit("other")), frame, grid).agg(F.min("height_cm"), F.max("height_cm")).collect()[0] == (0.0, 0.0)


def test_layers_keep_their_source_ids(spark):
    own = spark.createDataFrame([(1, 70, "Amenity", "parking", True), (2, 71, "Amenity", "school", True), (3, 72, "WaterBody", "", False)], "node_id long, osm_id long, node_type string, subtype string, is_area boolean")
    assert [(r.node_id, r.osm_id, r.layer) for r in M.area_layers(own).collect()] == [(1, 70, "Amenity")]


@pytest.mark.parametrize("name", ["footprints", "area_layers", "wall_bounds", "dry_run"])
def test_tables_without_rows(spark, tmp_path, name):
    for t in ("orders", "lineitem", "part"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
