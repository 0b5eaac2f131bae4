"""Nodes that share a source, and terrain in graphs of several regions."""

from pyspark.sql import functions as F

from citygeo.operators import graph as G

FEATURE = "osm_id long, feature_type string, subtype string, is_area boolean, points array<struct<lat: double, lon: double>>, tags map<string,string>, computed struct<name: string, height_m: double, width_m: double>, region_key string"
EDGES = "region_key string, edge_type string, src long, dst long, value double, tolerance_m double"
REGION = "region_key string, min_lat double, min_lon double, max_lat double, max_lon double"


def square(at):
    return [(at, 1.0), (at, 1.001), (at + 0.001, 1.001), (at, 1.0)]


def feature(osm_id, kind="Building", at=1.0, tags=None):
    return (osm_id, kind, "yes", True, square(at), tags or {}, ("", 1.0, 1.0), "r")


def test_twins_are_nodes_of_their_own_and_flagged(spark):
    rows = [feature(5), feature(5, at=1.01), feature(6), feature(6, at=1.02), feature(6), feature(7), feature(7, "Amenity"), feature(8), feature(0), feature(0), feature(0, at=1.03), feature(None), feature(9, tags={"a": "b"}), feature(9, tags={"a": "c"})]
    nodes, rejected = G.graph_nodes(spark.createDataFrame(rows, FEATURE), 1.0)
    own = nodes.collect()
    assert rejected.count() == 0 and len(own) == len({r.node_id for r in own}) == len(rows)
    again = G.graph_nodes(spark.createDataFrame(rows[::-1], FEATURE).repartition(3), 1.0)[0]
    assert sorted(r.node_id for r in again.collect()) == sorted(r.node_id for r in own)
    flagged = G.validate_nodes(nodes, spark.createDataFrame([], EDGES), spark.createDataFrame([("r", 0.0, 0.0, 2.0, 2.0)], REGION))
    counts = {r.osm_id: r.n for r in flagged.groupBy("osm_id").agg(F.count_if(F.array_contains("flags", "node.osmid.duplicate")).alias("n")).collect()}
    assert counts == {5: 1, 6: 2, 7: 1, 8: 0, 9: 1, 0: 0}
    count = lambda n: spark.createDataFrame([("r", n)], "region_key string, n long")
    report = {r.code: r.message for r in G.graph_report(flagged, count(len(rows)), count(0)).collect()}
    assert report["graph.osmid.duplicate"].startswith("5 ") and "graph.features.unaccounted" not in report


def test_terrain_is_a_node_in_each_region_that_it_covers(spark):
    regions = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 40.0, 0.0, 41.0, 1.0), ("c", 50.0, 0.0, 51.0, 1.0)], REGION)
    tiles = spark.createDataFrame([("t", 10, 10, [0.0, 0.2, 0.0, 1.0, 0.0, -0.1]), ("u", 10, 420, [0.0, 0.2, 0.0, 41.0, 0.0, -0.1])], "tile_id string, width int, height int, gt array<double>")
    stats = spark.createDataFrame([("t", 5.0, 9.0), ("u", 3.0, 3.0)], "tile_id string, min_elev double, max_elev double")
    terrain = G.terrain_nodes(tiles, stats, regions)
    found = {(r.region_key, r.name): (r.metrics.area_m2, r.flags) for r in terrain.collect()}
    assert set(found) == {("a", "t"), ("a", "u"), ("b", "u")} and found["a", "u"][0] > found["b", "u"][0] and found["b", "u"][1] == ["node.terrain.norelief"]
    features = spark.createDataFrame([feature(1, at=0.5)], FEATURE).withColumn("region_key", F.lit("a"))
    graph = G.build_city_graph(features, regions, 0.5, terrain=terrain)
    kinds = [r.node_type for r in graph["nodes"].collect()]
    assert sorted(kinds) == ["Building"] + ["TerrainTile"] * 3
    assert all("node.geometry.outsideregion" not in r.flags for r in graph["nodes"].filter("node_type = 'TerrainTile'").collect())


def test_a_building_in_a_courtyard_is_in_no_zone(spark):
    square = lambda a, b: [(a, a), (a, b), (b, b), (b, a), (a, a)]
    zone = (1, "Landuse", "grass", True, square(0.0, 0.01), {}, ("", 0.0, 0.0), "r", [square(0.004, 0.006), square(0.008, 0.009)])
    house = lambda k, at: (k, "Building", "yes", True, square(at, at + 0.0002), {}, ("", 1.0, 1.0), "r", None)
    rows = [zone, house(2, 0.001), house(3, 0.005), house(4, 0.0085), house(5, 0.007), house(6, 0.02)]
    features = spark.createDataFrame(rows, FEATURE + ", holes array<array<struct<lat: double, lon: double>>>")
    nodes = G.graph_nodes(features, 0.0)[0]
    names = {r.node_id: r.osm_id for r in nodes.collect()}
    assert {names[r.dst] for r in G.contains_edges(nodes).collect()} == {2, 5}
    rings = {(r.node_id, r.ring_no): r["count"] for r in G.geom_points(nodes).groupBy("node_id", "ring_no").count().collect()}
    own = next(k for k, v in names.items() if v == 1)
    assert [rings[own, k] for k in range(3)] == [5, 5, 5] and len(rings) == 3 + 5
    assert {names[r.node_id] for r in G.geom_ring(nodes, 2).collect()} == {1}
    bounds = {names[r.node_id]: r for r in G.geom_bounds(G.geom_points(nodes)).collect()}
    assert bounds[1].rings == 3 and bounds[1].points == 15 and bounds[2].rings == 1


def test_a_hub_is_paired_in_many_tasks(spark):
    n = 2000
    members = spark.range(n).select(F.lit("r").alias("region_key"), F.lit(1).cast("long").alias("junction_id"), F.col("id").alias("road"), F.lit(n).cast("long").alias("n_roads"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = G.connects_to_edges(members, most=100).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("src", "dst").alias("different")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pairs = n * (n - 1) // 2
    assert sum(t.n for t in tasks) == sum(t.different for t in tasks) == pairs == G.junction_classes(members).first().n_pairs
    assert len(tasks) > 6 and max(t.n for t in tasks) < pairs / 3


def test_groups_of_any_size_are_chunks(spark):
    ids = spark.range(5000).select(F.lit("r").alias("region_key"), F.lit("Category").alias("kind"), F.lit("Buildings").alias("name"), F.lit("Building").alias("node_type"), F.xxhash64("id").alias("node_id"))
    one = spark.createDataFrame([("r", "Corridor", "a", "RoadSegment", 7), ("r", "Corridor", "a", "RoadSegment", 7), ("r", "Corridor", "b", "RoadSegment", 9)], ids.schema)
    chunks = G.graph_groups(ids.unionByName(one), most=300).collect()
    own = sorted((c.first, c.node_ids) for c in chunks if c.name == "Buildings")
    assert all(len(c.node_ids) <= 300 for c in chunks) and len(own) > 16
    assert [i for _, part in own for i in part] == sorted(r.node_id for r in ids.collect()) and all(f == sum(len(p) for _, p in own[:k]) for k, (f, _) in enumerate(own))
    assert {(c.name, c.size, tuple(c.node_ids)) for c in chunks if c.kind == "Corridor"} == {("a", 2, (7, 7)), ("b", 1, (9,))}
