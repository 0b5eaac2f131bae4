"""Pairs of roads, zones and buildings, and sensors: shapes and places that many share are looked at once, and no pair is lost."""

import math
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from citygeo.operators import graph as G
from citygeo.operators import spatial, terrain, thermal
from citygeo.operators import graph_queries as N

FEATURE = "osm_id long, feature_type string, subtype string, is_area boolean, points array<struct<lat: double, lon: double>>, tags map<string,string>, computed struct<name: string, height_m: double, width_m: double>, region_key string"
REGION = "region_key string, min_lat double, min_lon double, max_lat double, max_lon double"


def square(lat, lon, side):
    return [(lat, lon), (lat, lon + side), (lat + side, lon + side), (lat + side, lon), (lat, lon)]


def area(osm_id, kind, ring):
    return (osm_id, kind, "yes", True, ring, {}, ("", 1.0, 1.0), "r")


def road(osm_id, *line):
    return (osm_id, "Highway", "path", False, list(line), {}, ("", 0.0, 2.0), "r")


def towns():
    """Many copies of a few zones, buildings and roads."""
    rows = [area(100 + i, "Building", square(0.001 * (i % 3), 0.001, 0.0002)) for i in range(9)]
    rows += [area(200 + i, "Landuse", square(-0.0005, 0.0005, 0.001 + 0.003 * (i % 2))) for i in range(8)]
    rows += [road(300 + i, (0.0, 0.0), (0.0, 0.00102), (0.0, 0.002)) for i in range(5)]
    return rows + [road(400 + i, (0.0, 0.002), (0.001, 0.002), (0.0, 0.00102)) for i in range(4)] + [road(500, (0.002, 0.0), (0.003, 0.0))]


def test_each_pair_of_roads_is_one_row(spark):
    lines = {i: [(i % 4, k) for k in range(5)] if i % 3 else [(k, i % 5) for k in range(4)] for i in range(60)}
    rows = [("r", i, a, b) for i, line in lines.items() for a, b in line]
    points = spark.createDataFrame(rows, "region_key string, node_id long, qlat long, qlon long")
    want = {(a, b): n for a, b in combinations(range(60), 2) if (n := len(set(lines[a]) & set(lines[b])))}
    for most in (256, 3):
        got = G.road_pairs(points, most).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.places for r in got} == want


def test_groups_of_ids_are_dealt_and_whole(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0.5).alias("k"), F.col("id").alias("v"))
    got = spatial.gathered(df, ["k"], "v", most=50).collect()
    assert sorted(i for r in got for i in r.ids) == list(range(1000))
    assert len(got) > 15 and max(len(r.ids) for r in got) < 120 and {r.k for r in got} == {0.5, None}


def test_copies_of_zones_and_buildings_lose_no_pair(spark):
    nodes = G.graph_nodes(spark.createDataFrame(towns(), FEATURE), 0.0)[0].withColumn("node_id", F.col("osm_id"))
    want = {(200 + z, 100 + b) for z, b in product(range(8), range(9)) if b % 3 == 0 or z % 2 and b % 3 < 3 and 0.001 * (b % 3) + 0.0001 < 0.0035}
    got = [(r.src, r.dst) for r in G.contains_edges(nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = G.contains_pairs(nodes).collect()
    assert sum(len(r.zones) * len(r.buildings) for r in pairs) == len(want) and len(pairs) < len(want) / 4
    fronts = {r.src: r for r in G.fronts_onto_edges(nodes, 0.0).collect()}
    assert set(fronts) == {100, 103, 106} and {r.dst for r in fronts.values()} == {400}
    assert len({r.value for r in fronts.values()}) == 1


def test_flags_make_no_pairs(spark, monkeypatch):
    """Nodes and issues of a graph are read from links alone: pairs of roads and of zones and buildings are made by those who read edges."""
    kept = []
    monkeypatch.setattr(G, "cut", lambda df: kept.append(df.columns) or df.localCheckpoint())
    regions = spark.createDataFrame([("r", -1.0, -1.0, 1.0, 1.0)], REGION)
    graph = G.build_city_graph(spark.createDataFrame(towns(), FEATURE), regions, 0.0)
    assert [c for c in kept if "edge_type" in c] == [["region_key", "edge_type", "src", "dst", "value", "tolerance_m"]]
    plan = graph["nodes"]._jdf.queryExecution().toString()
    assert "ConnectsTo" not in plan and "Contains" not in plan
    kinds = {r.edge_type: r.edges for r in N.count_edges(graph["edges"]).collect()}
    assert kinds["FrontsOnto"] == 3 and kinds["SharesNode"] == 5 + 9 + 9 + 4 and kinds["ConnectsTo"] == 10 + 36 + 36 + 6


def test_summary_takes_edges_by_number(spark):
    none = spark.createDataFrame([], "node_type string")
    edges = spark.createDataFrame([("SharesNode",)] * 3, "edge_type string")
    members = spark.createDataFrame([], "kind string, name string")
    counted = spark.createDataFrame([("ConnectsTo", 40), ("Contains", 0)], "edge_type string, edges long")
    got = {(r.section, r.name): r["count"] for r in N.graph_summary(none, edges, members, counted).collect()}
    assert got == {("total", "nodes"): 0, ("total", "edges"): 43, ("edge", "SharesNode"): 3, ("edge", "ConnectsTo"): 40}


def test_sensors_of_one_place_are_all_near(spark):
    zones = spark.createDataFrame([(i, float(i % 3) * 30, 0.0, 0.0) for i in range(12)], "zone_id long, x double, y double, z double")
    sensors = spark.createDataFrame([(i, float(i % 2) * 60, 0.0, 0.0) for i in range(10)], "sensor_id long, x double, y double, z double")
    want = {(a, b) for a, b in product(range(12), range(10)) if abs((a % 3) * 30 - (b % 2) * 60) <= 30}
    got = [(r.zone_id, r.sensor_id) for r in thermal.zones_near(zones, sensors, 30.0).collect()]
    assert len(got) == len(want) and set(got) == want


def test_places_far_from_the_origin_come_back(spark):
    """7 degrees from the origin: a float of a centimetre count is off by decimetres."""
    pixels = spark.createDataFrame([("t", r, c, 900.0) for r in range(5) for c in range(5)], "tile_id string, row int, col int, elev float")
    tiles = spark.createDataFrame([("t", 5, 5, [84.8, 0.0003, 0.0, 12.983, 0.0, -0.0003])], "tile_id string, width int, height int, gt array<double>")
    assert terrain.dem_alignment_error(pixels, tiles, 12.975, 77.607, 900.0).first().arc_seconds < 1e-4
    assert dict(terrain.dem_pixel_world(pixels, tiles, 12.975, 77.607, 900.0).select("enu.*").dtypes) == {"east": "double", "north": "double", "up": "double"}


@pytest.mark.parametrize("closed", [True, False])
def test_shape_metrics_are_those_of_single_functions(spark, closed):
    from citygeo.functions import geo

    rows = [([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)],), ([(0.1, 0.2), (0.3, 0.7)],), ([(0.1, 0.2), (0.3, 0.7), (0.5, 1.2)],), ([(0.1, 0.2)],), ([],)]
    df = spark.createDataFrame(rows, "points array<struct<lat: double, lon: double>>")
    p, mid = F.col("points"), F.lit(0.5)
    one = geo.shape_metrics(p, F.lit(closed), mid)
    middle = F.when(F.size(p) >= 3, geo.ring_centroid(F.when(F.size(p) >= 3, p))).otherwise(geo.vertex_mean(p)) if closed else geo.vertex_mean(p)
    for r in df.filter(F.size(p) > 0).select(one.alias("m"), geo.ring_length_m(p, mid, closed).alias("length"), (geo.ring_area_m2(p, mid) if closed else F.lit(0.0)).alias("area"), middle.alias("at")).collect():
        assert r.m.area_m2 == r.area and r.m.length_m == r.length and math.isclose(r.m.centroid.lat, r.at.lat) and math.isclose(r.m.centroid.lon, r.at.lon)


def test_fingerprint_makes_no_pairs(spark):
    """Zones and buildings tell the digest what contains what, however they are dealt into rows, and each other pair is another digest."""
    nodes = spark.createDataFrame([("r", 1, "Building", "yes", "", 5, {}, [(1.0, 2.0)], [], [])], "region_key string, node_id long, node_type string, subtype string, name string, osm_id long, tags map<string,string>, points array<struct<lat: double, lon: double>>, holes array<array<double>>, flags array<string>")
    edges = spark.createDataFrame([], "region_key string, edge_type string, src long, dst long, value double")
    held = lambda *rows: spark.createDataFrame([("r", list(z), list(b)) for z, b in rows], "region_key string, zones array<long>, buildings array<long>")
    digest = lambda pairs: G.graph_fingerprint(nodes, edges, held=pairs).first().fingerprint
    whole = digest(held(([1, 2], [7, 8, 9])))
    assert whole == digest(held(([1], [9, 7]), ([2], [7, 8, 9]), ([1], [8]))) == digest(held(([2, 1], [9]), ([1, 2], [8, 7])))
    others = [digest(held(*rows)) for rows in ([([1, 2], [7, 8])], [([1, 2], [7, 8]), ([1], [9])], [([1], [7]), ([2], [8])], [([1], [8]), ([2], [7])], [([7, 8, 9], [1, 2])])]
    assert len({whole, *others}) == 6


def test_readers_of_flags_and_ids_make_no_metrics_and_move_no_shapes(spark):
    regions = spark.createDataFrame([("r", -1.0, -1.0, 1.0, 1.0)], REGION)
    nodes = G.graph_nodes(spark.createDataFrame(towns(), FEATURE), 0.0)[0]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan(nodes.select("metrics.area_m2")) and "aggregate(" not in plan(nodes.select("node_id", "points", "metrics.width_m"))
    links = spark.createDataFrame([], "region_key string, edge_type string, src long, dst long, value double, tolerance_m double")
    flagged = G.validate_nodes(nodes, links, regions).select("node_id", "flags")._jdf.queryExecution().optimizedPlan()

    def joined(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        own = [below[0].output().mkString(" ")] if node.nodeName() == "Join" else []
        return own + [x for b in below for x in joined(b)]

    moved = next(x for x in joined(flagged) if "_shaped" in x)
    assert "points" not in moved and "tags" not in moved and "metrics" not in moved


def test_centroids_of_buildings_are_kept(spark, monkeypatch):
    """A join on a centroid reads it several times: it is made before, once."""
    kept = []
    nodes = G.graph_nodes(spark.createDataFrame(towns(), FEATURE), 0.0)[0]
    monkeypatch.setattr(G, "cut", lambda df: kept.append(df.columns) or df.localCheckpoint())
    G.fronts_onto_edges(nodes, 0.0)
    G.contains_pairs(nodes)
    assert [c for c in kept if {"lat", "lon"} < set(c) and {"building", "node_id"} & set(c)] == [["region_key", "building", "lat", "lon"], ["region_key", "node_id", "lat", "lon"]]
