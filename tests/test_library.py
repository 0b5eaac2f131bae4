"""Functions that the queries do not reach, on small hand-made frames."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from citygeo.functions import geo
from citygeo.operators import assets as A
from citygeo.operators import features as C
from citygeo.operators import graph as G
from citygeo.operators import materials as K
from citygeo.operators import mesh as M
from citygeo.operators import quality as V
from citygeo.operators import region as R
from citygeo.operators import terrain as E
from citygeo.operators import thermal as H
from citygeo.sources import dem, osm_xml, store

POINTS = "array<struct<lat: double, lon: double>>"

OSM = """<?xml version="1.0"?><osm version="0.6">
<node id="1" lat="12.971" lon="77.603"><tag k="a" v="1"/><tag k="a" v="2"/></node><node id="2" lat="12.972" lon="77.603"/><node id="3" lat="12.972" lon="77.604"/>
<node id="4" lat="13.5" lon="77.6"/><node id="5" lat="12.9699" lon="77.6019"/><node id="1" lat="12.9711" lon="77.603"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="house"/></way>
<way id="11"><nd ref="3"/><nd ref="99"/><nd ref="2"/><tag k="highway" v="path"/></way><way id="12"><nd ref="4"/><nd ref="5"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><member type="way" ref="12" role="inner"/><tag k="type" v="multipolygon"/></relation>
</osm>"""


@pytest.fixture(scope="module")
def osm(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("osm")
    (folder / "ok.osm").write_text(OSM)
    return osm_xml.read_osm_xml(spark, str(folder / "ok.osm"))


def test_xml_scan(osm):
    nodes, ways, relations = ({r.id: r for r in df.collect()} for df in osm)
    assert len(nodes) == 5 and nodes[1].lat == 12.9711 and nodes[1].tags == {}
    assert ways[10].closed and not ways[11].closed and ways[11].refs == [3, 99, 2]
    assert [m.role for m in relations[20].members] == ["outer", "inner"] and relations[20].tags == {"type": "multipolygon"}


def test_import_from_xml(spark, osm):
    nodes, ways, _ = osm
    refs = osm_xml.way_nodes(ways)
    found = {r.osm_id: r for r in C.build_features(refs, nodes, ways.select(F.col("id").alias("way_id"), "tags")).collect()}
    assert set(found) == {10, 11} and found[10].computed.height_m == 8.0 and found[11].partial and found[11].tags[C.PARTIAL] == "true"
    lost = V.dangling_refs(refs, nodes).first()
    assert (lost.ways_affected, lost.refs_missing) == (1, 1)


def test_extract_follows_relations(spark, osm):
    regions = spark.createDataFrame([("r", 12.97, 77.602, 12.98, 77.612), ("far", 13.4, 77.5, 13.6, 77.7), ("sea", 0.0, 0.0, 0.1, 0.1)], "region_key string, min_lat double, min_lon double, max_lat double, max_lon double")
    ids = [{k: {r.id for r in df.collect() if r.region_key == k} for k in ("r", "far", "sea")} for df in osm_xml.extract_region(*osm, regions)]
    assert ids[0] == {"r": {1, 2, 3, 5}, "far": {4}, "sea": set()}
    assert ids[1] == {"r": {10, 11, 12}, "far": {10, 12}, "sea": set()} and ids[2] == {"r": {20}, "far": {20}, "sea": set()}


def test_file_gate(spark, tmp_path):
    files = {"ok.osm": OSM.encode(), "empty.osm": b"", "tiny.osm": b"<osm></osm>", "wide.osm": b"\xff\xfe" + OSM.encode("utf-16-le"), "html.osm": b"<html>" + b" " * 100, "cut.osm": OSM.encode()[: len(OSM) // 2]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r.scope.rsplit("/", 1)[-1]: r.code for r in V.osm_file_issues(spark, str(tmp_path)).collect()}
    assert found == {"empty.osm": "osm.file.empty", "tiny.osm": "osm.file.truncated", "wide.osm": "osm.encoding.utf16", "html.osm": "osm.root.missing", "cut.osm": "osm.file.truncated"}


def tiff(values, width, compression=1, scale=1 / 3600, geo_tags=True, bands=1):
    raw = struct.pack(f"<{len(values)}h", *values)
    data = zlib.compress(raw) if compression == 8 else raw
    tags = [(256, 3, [width]), (257, 3, [len(values) // width]), (258, 3, [16]), (259, 3, [compression]), (273, 4, [0]), (277, 3, [bands]), (279, 4, [len(data)]), (339, 3, [2])]
    if geo_tags:
        tags += [(33550, 12, [scale, scale, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 77.6, 12.99, 0.0])]
    codes, sizes = {3: "H", 4: "I", 12: "d"}, {3: 2, 4: 4, 12: 8}
    head, extra, entries = 8 + 2 + 12 * len(tags) + 4, b"", []
    for tag, kind, vals in tags:
        body = struct.pack(f"<{len(vals)}{codes[kind]}", *vals)
        if len(body) > 4:
            entries.append((tag, kind, len(vals), struct.pack("<I", head + len(extra))))
            extra += body
        else:
            entries.append((tag, kind, len(vals), body.ljust(4, b"\0")))
    at = head + len(extra)
    entries = [(t, k, n, struct.pack("<I", at) if t == 273 else v) for t, k, n, v in entries]
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in entries) + struct.pack("<I", 0) + extra + data


def test_rasters(spark, tmp_path):
    values = [900 + i for i in range(24)]
    files = {"plain.tif": tiff(values, 6), "packed.tif": tiff(values, 6, 8), "jpeg.tif": tiff(values, 6, 7), "meters.tif": tiff(values, 6, scale=30.0), "bare.tif": tiff(values, 6, geo_tags=False), "two.tif": tiff(values, 6, bands=2), "text.tif": b"not a raster", "N12E077.hgt": struct.pack(">1442401h", *([5] * 1442401))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    headers, pixels = dem.read_dem(spark, str(tmp_path))
    counts = {r.tile_id: r["count"] for r in pixels.groupBy("tile_id").count().collect()}
    assert counts["plain.tif"] == counts["packed.tif"] == 24 and counts["N12E077.hgt"] == 1201 * 1201 and "jpeg.tif" not in counts
    codes = {(r.scope, r.code) for r in V.dem_header_issues(headers.filter("error is null")).unionByName(dem.header_errors(headers)).collect()}
    assert codes == {("jpeg.tif", "tif.compression.unsupported"), ("meters.tif", "tif.pixelscale.implausible"), ("bare.tif", "tif.geotags.missing"), ("two.tif", "tif.bands.multiple"), ("text.tif", "tif.header.invalid")}
    same = pixels.filter("tile_id = 'plain.tif'").select("row", "col", "elev")
    assert same.exceptAll(pixels.filter("tile_id = 'packed.tif'").select("row", "col", "elev")).count() == 0
    assert V.dem_stats(pixels, headers).filter("tile_id = 'plain.tif'").first().complete


def test_elevation_fills_void_corners(spark):
    tiles = spark.createDataFrame([("t", 2, 2, [0.0, 1.0, 0.0, 2.0, 0.0, -1.0], -9999.0, True)], "tile_id string, width int, height int, gt array<double>, nodata double, has_nodata boolean")
    pixels = spark.createDataFrame([("t", 0, 0, 10.0), ("t", 0, 1, 20.0), ("t", 1, 0, -9999.0), ("t", 1, 1, 40.0)], "tile_id string, row int, col int, elev float")
    points = spark.createDataFrame([(1, "t", 1.5, 0.5), (2, "t", 1.0, 1.0), (3, "t", 9.0, 9.0), (4, "t", 0.5, 0.5)], "point_id int, tile_id string, lat double, lon double")
    found = {r.point_id: r.elev for r in E.sample_elevation(points, pixels, tiles).collect()}
    mean = (10 + 20 + 40) / 3
    assert found[1] == 10 and abs(found[2] - (10 + 20 + 40 + mean) / 4) < 1e-9 and found[3] is None and found[4] == 40


@pytest.fixture(scope="module")
def hill(spark):
    frame = E.terrain_frame(spark.createDataFrame([("r", 0.0, 0.0, 0.0, 0.0, 160.0, 160.0)], "region_key string, lat0 double, lon0 double, min_x double, min_y double, max_x double, max_y double"), 10.0)
    grid = E.terrain_grid(frame).withColumn("height_cm", (F.col("ix") * 37 % 11 * 20 + F.col("iy") * 53 % 13 * 15).cast("double"))
    return frame.cache(), grid.cache()


def test_ground_range_matches_a_dense_sweep(spark, hill):
    ring = [(12.3, 15.7), (61.9, 22.2), (70.4, 58.8), (20.1, 66.6)]
    polygons = spark.createDataFrame([("p", "r", [{"x": x, "y": y} for x, y in ring])], "line_id string, region_key string, points array<struct<x: double, y: double>>")
    exact = E.ground_range(polygons, *hill).first()
    inside = lambda x, y: sum(((b[1] > y) != (a[1] > y)) and x < (a[0] - b[0]) * (y - b[1]) / (a[1] - b[1]) + b[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2
    sweep = [(f"{x}/{y}", "r", x / 4, y / 4) for x in range(40, 300) for y in range(50, 280) if inside(x / 4, y / 4)]
    heights = E.terrain_height(spark.createDataFrame(sweep, "point_id string, region_key string, x_m double, y_m double"), *hill).agg(F.min("height_cm"), F.max("height_cm")).first()
    assert exact.min_cm <= heights[0] + 1e-6 and exact.max_cm >= heights[1] - 1e-6 and heights[0] - exact.min_cm < 10 and exact.max_cm - heights[1] < 10


def test_split_segments_are_coplanar(spark, hill):
    lines = spark.createDataFrame([("l", "r", [{"x": 3.0, "y": 4.0}, {"x": 95.0, "y": 51.0}, {"x": 20.0, "y": 140.0}], False)], "line_id string, region_key string, points array<struct<x: double, y: double>>, closed boolean")
    parts = [(r.x_m, r.y_m) for r in E.split_at_triangles(lines, hill[0]).orderBy("pos").collect()]
    assert parts[0] == (3.0, 4.0) and parts[-1] == (20.0, 140.0) and len(parts) > 30
    rows = [(f"{i}{k}", "r", a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t) for i, (a, b) in enumerate(zip(parts, parts[1:])) for k, t in (("a", 0.0), ("m", 0.5), ("z", 1.0))]
    h = {r.point_id: r.height_cm for r in E.terrain_height(spark.createDataFrame(rows, "point_id string, region_key string, x_m double, y_m double"), *hill).collect()}
    assert all(abs((h[f"{i}a"] + h[f"{i}z"]) / 2 - h[f"{i}m"]) < 0.01 for i in range(len(parts) - 1))


def test_terrain_mesh_is_a_sheet(hill):
    vertices, triangles = E.terrain_mesh(*hill)
    own, tri = vertices.withColumnRenamed("region_key", "mesh_id"), triangles.withColumnRenamed("region_key", "mesh_id").withColumn("section", F.lit("g"))
    closure = M.mesh_closure(own, tri).first()
    assert vertices.count() == 17 * 17 and triangles.count() == 2 * 256 and closure.open_edges == 64 and closure.crowded_edges == 0
    assert M.mesh_normals(own, tri).first().down + M.mesh_normals(own, tri).first().up > 0 and M.mesh_bounds(own).first().max_x == 16000


def test_asphalt_after_three_hours(spark):
    zones = K.with_material_props(spark.createDataFrame([(1, "Asphalt"), (2, "Water")], "zone_id long, category string")).withColumns({"normal": F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), "temp_k": F.lit(293.15)})
    readings = spark.range(2160).select((F.col("id") % 2 + 1).alias("zone_id"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.lit(10.0).alias("dt_s"), F.lit(800.0).alias("irradiance"), F.array(F.lit(0.0), F.lit(0.0), F.lit(-1.0)).alias("sun"), F.lit(303.15).alias("ambient_k"), F.lit(283.15).alias("sky_k"), F.lit(2.0).alias("wind"))
    t = {r.zone_id: r.temp_k for r in H.zone_temperatures(zones, readings).collect()}
    assert 300 < t[1] < 330 and t[1] > t[2] + 5


def test_weights_are_met(spark):
    rules = spark.createDataFrame([(1, 1, "RoadSegment", "", 5, False)], "rule_id int, rule_order int, node_type string, subtype string, seed long, per_corridor boolean")
    choices = spark.createDataFrame([(1, 0, "a", "A", 3.0), (1, 1, "b", "B", 1.0)], "rule_id int, idx int, asset string, label string, weight double")
    nodes = spark.range(4000).select(F.lit("r").alias("region_key"), F.col("id").alias("node_id"), F.lit("RoadSegment").alias("node_type"), F.lit("path").alias("subtype"), F.array().cast("array<string>").alias("flags"))
    share = A.select_assets(nodes, rules, choices).filter("idx = 0").count() / 4000
    assert 0.7 < share < 0.8
    new = spark.createDataFrame([(2, 9, "RoadSegment", "", 7)], "rule_id int, rule_order int, node_type string, subtype string, seed long")
    assert [(r.rule_id, r.per_corridor) for r in A.upsert_rules(rules, new).collect()] == [(2, True)]


def test_fingerprint_follows_content(spark):
    row = lambda i, lat: ("r", i, "Building", "house", "", i, {}, True, [(lat, 1.0), (lat, 2.0), (3.0, 3.0)], [], [])
    schema = f"region_key string, node_id long, node_type string, subtype string, name string, osm_id long, tags map<string,string>, is_area boolean, points {POINTS}, holes array<{POINTS}>, flags array<string>"
    edges = spark.createDataFrame([], "region_key string, edge_type string, src long, dst long, value double, tolerance_m double")
    print_of = lambda rows: G.graph_fingerprint(spark.createDataFrame(rows, schema), edges).first().fingerprint
    assert print_of([row(1, 1.0), row(2, 2.0)]) == print_of([row(2, 2.0), row(1, 1.0)]) != print_of([row(1, 1.0), row(2, 2.1)])


def test_holes_are_outside(spark):
    square = lambda a, b: F.array(*[F.struct(F.lit(x).cast("double").alias("lat"), F.lit(y).cast("double").alias("lon")) for x, y in ((a, a), (b, a), (b, b), (a, b))])
    rings = F.array(square(0, 10), square(4, 6))
    got = spark.range(1).select(*[G.in_area(F.lit(x), F.lit(5.1), rings).alias(str(x)) for x in (1.0, 5.0, 11.0)]).first()
    assert tuple(got) == (True, False, False)


def test_graph_and_mesh_files(spark, tmp_path):
    graph = {"nodes": spark.createDataFrame([("a", 1), ("b", 2)], "region_key string, node_id int")}
    store.write_graph(graph, str(tmp_path / "g"))
    store.write_graph({"nodes": spark.createDataFrame([("b", 3)], "region_key string, node_id int")}, str(tmp_path / "g"))
    assert {r.node_id for r in store.read_graph(spark, str(tmp_path / "g"), ["nodes"])["nodes"].collect()} == {1, 3}
    assert store.read_graph(spark, str(tmp_path / "g"), ["nodes"], "a")["nodes"].count() == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "m.json").write_text('{"header": 1}\n{"kind":"road","label":"x","loc":[0,0,0],"v":[1,2,3],"t":[0]}\n{broken\n')
    assert [r.kind for r in store.read_mesh_dump(spark, str(tmp_path / "d")).collect()] == ["road"]


def test_cache_decision(spark):
    box = (12.0, 77.0, 12.1, 77.1)
    requests = spark.createDataFrame([(1, *box, "SRTM", 0.001), (2, *box, "COP", 0.001), (3, *box, "SRTM", 0.002), (4, 1.0, 1.0, 2.0, 2.0, "SRTM", 0.001)], "request_id int, min_lat double, min_lon double, max_lat double, max_lon double, dem_type string, padding_deg double")
    manifests = spark.createDataFrame([(1, "SRTM", 0.001, 10, 20, "x", *box)], ", ".join(store.MANIFEST.values()))
    key = requests.filter("request_id = 1").select(store.cache_key().alias("k")).first().k
    files = spark.createDataFrame([(key, 10, 20)], "cache_key string, osm_length long, dem_length long")
    assert {r.request_id: r.reusable for r in store.cache_reusable(requests, manifests, files).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_cross_file_gate(spark):
    box = "region_key string, min_lat double, min_lon double, max_lat double, max_lon double"
    regions, seen = (spark.createDataFrame([("r", *b)], box) for b in ((12.97, 77.60, 12.98, 77.61), (12.971, 77.601, 12.979, 77.609)))
    tile = lambda name, lon, w, lat=13.0, h=100: (name, w, h, [lon, 0.001, 0.0, lat, 0.0, -0.001], -1.0, True)
    schema = "tile_id string, width int, height int, gt array<double>, nodata double, has_nodata boolean"
    code = lambda *tiles: sorted((r.scope, r.code) for r in V.cross_file_issues(seen, regions, spark.createDataFrame(list(tiles), schema)).collect())
    assert code(tile("t", 77.5, 200)) == [] and code(tile("t", 10.0, 10)) == [("r", "cross.files.disjoint")]
    assert code(tile("t", 77.5, 105)) == [("r", "cross.dem.coverage.insufficient")] and code(tile("t", 77.6005, 200)) == [("r", "cross.dem.coverage.partial")]
    # several rasters cover a region together, overlaps once
    assert code(tile("a", 77.5, 105), tile("b", 77.603, 200)) == [] and code(tile("a", 77.5, 104), tile("b", 77.602, 4), tile("c", 77.606, 100)) == []
    assert code(tile("a", 77.5, 105), tile("b", 77.5, 104)) == [("r", "cross.dem.coverage.insufficient")]
    assert code(tile("t", 77.5, 200), tile("flat", 77.5, 0)) == [("flat", "cross.dem.bounds.invalid")]


def test_regions(spark):
    own = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 0.5, 0.5, 2.0, 2.0), ("c", 0.1, 0.1, 0.2, 0.2)], "region_key string, min_lat double, min_lon double, max_lat double, max_lon double")
    got = {(r.a_key, r.b_key): r for r in R.box_relations(own, own).collect()}
    assert got["a", "c"].contains and got["a", "b"].covered == pytest.approx(0.25 / 2.25) and not got.get(("b", "c"), got["a", "b"]).contains
    grown = R.region_expand(own, 100.0).first()
    assert (grown.min_lat, grown.max_lon) == (-90.0, 101.0)
    assert own.select(R.region_key().alias("k")).first().k == "0.0000000,0.0000000,1.0000000,1.0000000"


def test_boxes_of_all_sizes_meet_as_in_all_pairs(spark):
    import random

    deal = random.Random(5)
    box = lambda k: (lambda a, b, h, w: (f"r{k}", a, b, a + h, b + w))(deal.uniform(-2, 2), deal.uniform(-2, 2), *(deal.choice([0.002, 0.01, 0.2, 3.0]) * deal.random() for _ in "hw"))
    boxes = [box(k) for k in range(60)] + [("edge", 0.0, 0.0, 0.01, 0.01), ("next", 0.01, 0.0, 0.02, 0.01), ("same", 0.0, 0.0, 0.01, 0.01)]
    points = [(k, deal.uniform(-2, 2), deal.uniform(-2, 2)) for k in range(200)] + [(-1, 0.01, 0.01)]
    regions = spark.createDataFrame(boxes, "region_key string, min_lat double, min_lon double, max_lat double, max_lon double")
    own = spark.createDataFrame(points, "id long, lat double, lon double")
    got = sorted((r.id, r.region_key) for r in R.points_in_region(own, regions).collect())
    assert got == sorted((i, k) for i, y, x in points for k, a, b, c, d in boxes if a <= y <= c and b <= x <= d)
    met = [(r.a_key, r.b_key, r.intersects) for r in R.box_relations(regions, regions).collect()]
    touch = [(p, q) for p in boxes for q in boxes if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(met) == sorted((p[0], q[0], p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]) for p, q in touch)
    line = spark.createDataFrame([(1, [(y, x) for _, y, x in points[:9]]), (2, [(0.005, 0.005), (0.5, 0.5)])], "osm_id long, points array<struct<lat: double, lon: double>>")
    clipped = sorted((r.osm_id, r.region_key) for r in C.clip_features(line, regions, margin=0.0).collect())
    lines = [(1, points[:9]), (2, [(0, 0.005, 0.005), (0, 0.5, 0.5)])]
    assert clipped == sorted((i, k) for i, ps in lines for k, a, b, c, d in boxes if any(a <= y <= c and b <= x <= d for _, y, x in ps))


def test_geoid_between_nodes(spark):
    got = spark.range(1).select(geo.geoid_separation(F.lit(85.0), F.lit(-175.0)).alias("a"), geo.geoid_separation(F.lit(-89.0), F.lit(185.0)).alias("b")).first()
    assert got.a == pytest.approx((13 + 13 + 29 + 29) / 4) and got.b == pytest.approx((27 + 30) / 2)


def test_archetype_heights(spark):
    height = lambda tag, levels, jitter: M.archetype_height(F.lit(tag), F.lit(levels), F.lit(5), jitter_m=jitter)
    got = spark.range(1).select(height(12.5, 4, 2.0).alias("a"), height(0.0, 4, 0.0).alias("b"), height(0.0, 0, 0.0).alias("c"), height(0.0, 4, 2.0).alias("d")).first()
    assert (got.a, got.b, got.c) == (12.5, 12.8, 9.6) and 10.8 <= got.d <= 14.8
