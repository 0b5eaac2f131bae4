"""Import reports of several regions, manifests as they are written, and crossings of long lines."""

import json

from pyspark.sql import functions as F

from citygeo.operators import quality as V
from citygeo.operators import terrain as E
from citygeo.sources import store


BOX = "region_key string, min_lat double, min_lon double, max_lat double, max_lon double"
TILE = "tile_id string, width int, height int, gt array<double>, nodata double, has_nodata boolean"


def town(source, lat, lon, first):
    """A square of four nodes, about a kilometre a side, and its way."""
    at = [(0.0, 0.0), (0.009, 0.0), (0.009, 0.009), (0.0, 0.009)]
    return [(source, first + k, lat + a, lon + b) for k, (a, b) in enumerate(at)], [(source, first, k, first + k % 4) for k in range(5)]


def report(spark, towns, regions, tiles=None, pixels=None, by="source", features=None):
    nodes = spark.createDataFrame([n for t in towns for n in t[0]], "source string, id long, lat double, lon double")
    ways = spark.createDataFrame([w for t in towns for w in t[1]], "source string, way_id long, seq int, node_id long")
    own = [r[0] for r in regions] if features is None else features
    found = spark.createDataFrame([(k, "Building") for k in own], "region_key string, feature_type string")
    dem = (None, None) if tiles is None else (spark.createDataFrame(tiles, TILE), spark.createDataFrame(pixels, "tile_id string, row int, col int, elev float"))
    issues, _ = V.import_report(nodes, ways, found, spark.createDataFrame(regions, BOX), *dem, by=by)
    return {(r.scope, r.code) for r in issues.collect()}


def test_a_fatal_region_stops_itself_alone(spark):
    regions = [("here", 12.965, 77.595, 12.985, 77.615), ("far", 48.0, 11.0, 48.01, 11.01), ("flat", 1.0, 1.0, 1.0, 2.0)]
    found = report(spark, [town("a", 12.97, 77.6, 1)], regions, features=[])
    assert found == {("far", "osm.bounds.disjoint"), ("here", "import.dem.absent"), ("here", "import.features.none"), ("flat", "import.region.invalid")}


def test_a_fatal_raster_stops_the_regions_that_it_lies_under(spark):
    regions = [("a", 12.965, 77.595, 12.985, 77.615), ("b", 20.0, 30.0, 20.02, 30.02)]
    tiles = [("ta", 10, 10, [77.5, 0.02, 0.0, 13.0, 0.0, -0.01], -1.0, True), ("tb", 10, 10, [29.9, 0.02, 0.0, 20.1, 0.0, -0.02], -1.0, True), ("nowhere", 2, 2, [0.0, 1.0, 0.0, 1.0, 0.0, -1.0], -1.0, True)]
    pixels = [(t, r, c, -1.0 if t == "ta" else 5.0) for t in ("ta", "tb") for r in range(10) for c in range(10)]
    found = report(spark, [town("x", 12.97, 77.6, 1), town("y", 20.005, 30.005, 10)], regions, tiles, pixels, features=[])
    assert found == {("ta", "tif.elevation.allnodata"), ("nowhere", "tif.raster.incomplete"), ("b", "import.features.none")}


def test_a_fatal_source_stops_its_regions_and_their_rasters(spark):
    regions = [("a", 12.965, 77.595, 12.985, 77.615), ("b", 20.0, 30.0, 20.02, 30.02)]
    bad = ([*town("x", 12.97, 77.6, 1)[0], ("x", 9, 100.0, 0.0)], town("x", 12.97, 77.6, 1)[1] + [("x", 9, 0, 77)])
    tiles = [("ta", 10, 10, [77.5, 0.02, 0.0, 13.0, 0.0, -0.01], -1.0, True), ("tb", 10, 10, [29.9, 0.02, 0.0, 20.1, 0.0, -0.02], -1.0, True)]
    found = report(spark, [bad, (town("y", 20.005, 30.005, 10)[0], town("y", 20.005, 30.005, 10)[1] + [("y", 11, 0, 78)])], regions, tiles, [])
    assert found == {("x", "osm.coords.invalid"), ("y", "osm.refs.dangling"), ("tb", "tif.raster.incomplete")}
    assert report(spark, [bad], regions[:1], by=None) == {("all", "osm.coords.invalid")}


def test_a_road_that_leaves_the_region_makes_its_data_large(spark):
    nodes, ways = town("a", 12.97, 77.6, 1)
    far = [("a", 20, 12.9, 77.0), ("a", 21, 12.91, 77.1), ("a", 22, 12.95, 77.7)]
    regions = [("here", 12.965, 77.595, 12.985, 77.615), ("there", 48.0, 11.0, 48.02, 11.02)]
    other = town("b", 48.005, 11.005, 40)
    found = report(spark, [(nodes + far, ways + [("a", 20, k, 20 + k) for k in range(3)]), other], regions)
    assert ("here", "osm.bounds.oversized") in found and ("there", "osm.bounds.oversized") not in found
    assert ("here", "osm.bounds.oversized") not in report(spark, [(nodes, ways), other], regions)


def test_groups_are_components_of_cells(spark):
    import random

    deal = random.Random(3)
    places = [(k, deal.uniform(0, 1), deal.uniform(0, 1)) for k in range(300)]
    nodes = spark.createDataFrame(places + [(900, None, 1.0), (901, 91.0, 1.0)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(1, 0, 5), (1, 1, 250), (1, 2, 999)], "way_id long, seq int, node_id long")
    cells = {k: (int(y // 0.02), int(x // 0.02)) for k, y, x in places}
    label = {k: k for k in cells}
    link = lambda p, q: [label.__setitem__(k, min(label[p], label[q])) for k in [k for k in label if label[k] in (label[p], label[q])]]
    for p in cells:
        for q in cells:
            if max(abs(cells[p][0] - cells[q][0]), abs(cells[p][1] - cells[q][1])) <= 1 and label[p] != label[q]:
                link(p, q)
    link(5, 250)
    sizes = sorted(list(label.values()).count(v) for v in set(label.values()))
    assert sorted(r.n_nodes for r in V.data_groups(nodes, ways).collect()) == sizes


def test_manifests_are_read_as_they_are_written(spark, tmp_path):
    manifest = {"version": 1, "minLat": 12.5, "maxLat": 12.6, "minLon": 77.5, "maxLon": 77.6, "overpassUrl": "x", "demType": "A", "demPaddingDegrees": 0.001, "fetchedAtUtc": "2024-01-01T00:00:00Z", "osmFileSize": 10.0, "demFileSize": 20.0, "lastValidationVerdict": ""}
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=2))
    manifests = store.read_manifests(spark, str(tmp_path))
    requests = spark.createDataFrame([(1, 12.5, 77.5, 12.6, 77.6, "A", 0.001), (2, 12.5, 77.5, 12.6, 77.6, "B", 0.001)], "request_id int, min_lat double, min_lon double, max_lat double, max_lon double, dem_type string, padding_deg double")
    files = requests.limit(1).select(store.cache_key().alias("cache_key"), F.lit(10).cast("long").alias("osm_length"), F.lit(20).cast("long").alias("dem_length"))
    assert {r.request_id: r.reusable for r in store.cache_reusable(requests, manifests, files).collect()} == {1: True, 2: False}


def test_long_lines_keep_their_crossings(spark):
    frame = spark.createDataFrame([("r", 0.0, 0.0, 0.0, 0.0, 10.0, 10.0, 16, 16)], "region_key string, lat0 double, lon0 double, min_x double, min_y double, step_x double, step_y double, div_x int, div_y int")
    far = [(-1e6, 3.0), (1e6, 3.0)]
    lines = spark.createDataFrame([(1, "r", [{"x": x, "y": y} for x, y in far], False)], "line_id long, region_key string, points array<struct<x double, y double>>, closed boolean")
    inside = sorted(r.x_m for r in E.split_at_triangles(lines, frame).filter("x_m between -0.5 and 160.5").collect())
    grid, diagonal = [10.0 * k for k in range(17)], [10.0 * k + 3.0 for k in range(16)]
    assert all(min(abs(x - y) for y in inside) < 0.01 for x in grid + diagonal)
