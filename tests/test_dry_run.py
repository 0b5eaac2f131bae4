"""The dry run counts what the graph flags, and tells all that its operator does."""

from collections import Counter

from citygeo.operators import assets as A
from citygeo.operators import graph as G
from citygeo.plans import map_queries
from citygeo.plans.registry import QUERIES
from citygeo.sources import lens

FOLDER = "/root/testdata/sf0.001"


def test_every_flag_of_the_graph_is_counted(spark):
    types = {r.osm_id: r.node_type for r in map_queries.listed(spark, FOLDER).select("osm_id", "node_type").collect()}
    flags = {r.osm_id: r.flags.split(",") for r in QUERIES["node_flags"](spark, FOLDER).collect()}
    want = Counter(types[i] for i in flags)
    found = QUERIES["dry_run"](spark, FOLDER).collect()
    assert {r.node_type: r.flagged for r in found} == {t: want[t] for t in types.values()}
    assert {r.node_type: r.nodes for r in found} == Counter(types.values()) and all(r.selected + r.fallbacks == r.nodes for r in found)
    assert any("node.geometry.partial" not in own for own in flags.values())  # not flags of ways alone


def test_no_result_of_the_operator_is_left_out(spark):
    own = QUERIES["dry_run"](spark, FOLDER)
    assert own.columns == A.dry_run(map_queries.selections(spark, FOLDER)).columns
    kinds = {r.node_type: r.output_kind for r in own.collect()}
    assert kinds["Building"] == "point + polygon" and kinds["RoadSegment"] == "spline" and kinds["Amenity"] == "point" and kinds["WaterBody"] == "polygon"


def test_flags_leave_the_picks_alone(spark):
    columns = ["osm_id", "corridor", "idx", "asset", "outcome"]
    own = {tuple(r) for r in map_queries.selections(spark, FOLDER, map_queries.flagged_list(spark, FOLDER)).select(*columns).collect()}
    assert own == {tuple(r) for r in map_queries.selections(spark, FOLDER).select(*columns).collect()}


def test_flagged_nodes_of_a_small_graph(spark):
    line = lambda *at: [{"lat": a, "lon": b} for a, b in at]
    computed = {"height_m": 0.0, "levels": 0, "height_from_tags": False, "width_m": 0.0, "lanes": 0, "oneway": False, "name": "s"}
    square = lambda a, b: line((a, b), (a, b + 1e-4), (a + 1e-4, b + 1e-4), (a + 1e-4, b))
    rows = [
        ("r", 1, "Highway", "path", False, line((12.0, 77.0), (12.0, 77.001)), {}, computed, False),
        ("r", 2, "Highway", "path", False, line((12.0, 77.001), (12.001, 77.001)), {}, computed, False),
        ("r", 3, "Highway", "path", False, line((12.005, 77.0), (12.005, 77.001)), {}, computed, False),  # meets no road
        ("r", 4, "Building", "house", True, square(12.0001, 77.0005), {}, computed, False),
        ("r", 5, "Building", "house", True, square(12.009, 77.009), {}, computed, False),  # has no street
        ("r", 6, "Barrier", "fence", False, line((12.0, 77.0), (13.0, 77.0)), {}, computed, False),  # leaves the region
    ]
    point = "array<struct<lat: double, lon: double>>"
    kind = "struct<height_m: double, levels: int, height_from_tags: boolean, width_m: double, lanes: int, oneway: boolean, name: string>"
    features = spark.createDataFrame(rows, f"region_key string, osm_id long, feature_type string, subtype string, is_area boolean, points {point}, tags map<string,string>, computed {kind}, partial boolean")
    region = spark.createDataFrame([("r", 12.0, 77.0, 12.01, 77.01)], "region_key string, min_lat double, min_lon double, max_lat double, max_lon double")
    nodes = G.build_city_graph(features, region, 12.005)["nodes"]
    told = A.dry_run(A.select_assets(G.with_corridors(nodes), map_queries.rules(spark), map_queries.choices(spark)))
    assert {r.node_type: (r.nodes, r.selected, r.fallbacks, r.flagged) for r in told.collect()} == {"RoadSegment": (3, 3, 0, 1), "Building": (2, 2, 0, 1), "Barrier": (1, 0, 1, 1)}


def test_a_region_does_not_gather_its_nodes(spark):
    nodes = map_queries.nodes(spark, FOLDER)
    none = spark.createDataFrame([], "region_key string, edge_type string, src long, dst long, value double, tolerance_m double")
    plan = G.validate_nodes(nodes, none, lens.regions(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
