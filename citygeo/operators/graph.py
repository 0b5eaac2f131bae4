"""The city graph: nodes, edges, groups, flags and report.

Node ids are stable: a hash of region, type and source id or coordinate, so no numbering over all rows is needed; features that
share all three get ids of their own by what else they hold. Frames:
nodes(region_key, node_id, node_type, subtype, name, osm_id, tags, is_area, points, holes, metrics, flags): points are a line or the outer
ring, holes the inner rings; edges(region_key, edge_type, src, dst, value, tolerance_m); groups in long form(region_key, kind, name,
node_type, node_id) or in chunks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citygeo.functions.geo import CLIP_MARGIN, M_PER_DEGREE, point_in_ring, point_segment_m, ring_area_m2, ring_centroid, ring_length_m, shape_metrics
from citygeo.functions.numbers import case_of
from citygeo.functions.tags import PARTIAL, has_tag
from citygeo.operators.cut import cut
from citygeo.operators.quality import issue, issues_of
from citygeo.operators.region import dem_coverage, tile_bounds
from citygeo.operators.spatial import MOST_FEW, around, box_cells, cell, few, gathered, segment_cells, spread

# Node type of each feature type.
NODE_TYPES = {
    "Building": "Building", "Highway": "RoadSegment", "Waterway": "Waterway", "WaterArea": "WaterBody", "NaturalArea": "VegetationArea",
    "Landuse": "LanduseZone", "Leisure": "LeisureArea", "Railway": "Railway", "Barrier": "Barrier", "Power": "PowerLine", "Amenity": "Amenity",
}
# Node types in declaration order, and what a group of each is called in the singular.
NODE_NAMES = {
    "Building": "Building", "RoadSegment": "Road Segment", "Junction": "Junction", "WaterBody": "Water Body", "Waterway": "Waterway", "VegetationArea": "Vegetation Area",
    "LanduseZone": "Land Use Zone", "LeisureArea": "Leisure Area", "Railway": "Railway", "Barrier": "Barrier", "PowerLine": "Power Line", "Amenity": "Amenity", "TerrainTile": "Terrain Tile", "Block": "Block",
}
ZONES = ["LanduseZone", "LeisureArea", "VegetationArea"]
CUTOFF_M, LEAST_CELL_M = 50.0, 10.0
MOST_TWINS = 1_000_000  # ids that may be broadcast
MOST_IDS = 10_000  # members in a chunk of a group
ZONE_CELLS_DEG = [0.0001 * 4**k for k in range(8)]  # cells on which zones meet buildings; a zone is on those of about its size
HUB_ROADS = 256  # roads of a junction that one task pairs with all of them
PRIME = 2_147_483_647  # products of two numbers below it are longs
RINGS = "array<array<struct<lat:double,lon:double>>>"


@dataclass
class GraphOptions:
    contains: bool = True
    fronts_onto: bool = True
    corridors: bool = True
    cutoff_m: float = CUTOFF_M


def node_key(region: Column, node_type: Column, *source: Column) -> Column:
    return F.xxhash64(region, node_type, *source)


def _judged(features: DataFrame) -> DataFrame:
    kind, n = case_of(F.col("feature_type"), NODE_TYPES), F.col("n_points") if "n_points" in features.columns else F.size("points")
    reason = F.when(kind.isNull(), F.lit("no node type for this classification")).when(n < F.when(F.col("is_area"), 3).otherwise(2), F.lit("no usable geometry"))
    return features.withColumns({"node_type": kind, "reason": reason})


def graph_rejections(features: DataFrame) -> DataFrame:
    """Features that become no node, with the reason."""
    return _judged(features).filter("reason is not null").select("region_key", "osm_id", "feature_type", "subtype", "reason")


def _shape() -> Column:
    """Hash of what a node holds besides region, type and source id."""
    return F.xxhash64("subtype", "name", "points", "holes", F.to_json(F.array_sort(F.map_entries("tags"))))


def _told_apart(nodes: DataFrame, shape: Column | None = None) -> DataFrame:
    """nodes with a node_id each. Of nodes with one id the least by shape keeps it; the others get ids by shape, and equal ones by a
    count. Ids are counted first, and only rows that share one are grouped; up to MOST_TWINS such ids are broadcast."""
    twins = cut(nodes.groupBy("node_id").agg(F.count("*").alias("n")).filter("n > 1").select("node_id"))
    n = twins.count()
    if not n:
        return nodes
    meet = F.broadcast(twins) if n <= MOST_TWINS else twins
    shapes = nodes.join(meet, "node_id", "left_semi").withColumn("_shape", _shape() if shape is None else shape).groupBy("node_id", "_shape").agg(F.first(F.struct(*nodes.columns)).alias("row"), F.count("*").alias("_n"))
    first = shapes.groupBy("node_id").agg(F.min("_shape").alias("_first"))
    own = shapes.join(first, "node_id").select("row.*", "_shape", "_first", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_k"))
    key = F.when((F.col("_shape") == F.col("_first")) & (F.col("_k") == 1), F.col("node_id")).otherwise(node_key(F.col("region_key"), F.col("node_type"), F.col("osm_id"), F.col("_shape"), F.col("_k")))
    return cut(nodes.join(meet, "node_id", "left_anti").unionByName(own.withColumn("node_id", key).select(nodes.columns)))


def graph_nodes(features: DataFrame, mid_lat: Column | float) -> tuple[DataFrame, DataFrame]:
    """Nodes, and rejections (osm_id, feature_type, subtype, reason). features have region_key; every one is in one of the two. They
    are kept in the checkpoint folder. Features of one type and source id are several nodes; a source id of 0 or null is none.

    Features may have holes (inner rings). Area, length and centroid are those of the outer ring.
    """
    return _nodes_of(cut(features), mid_lat)


def _nodes_of(features: DataFrame, mid_lat: Column | float) -> tuple[DataFrame, DataFrame]:
    """graph_nodes of features that are kept. Metrics are made by those who read them, of the nodes that they read."""
    mid = mid_lat if isinstance(mid_lat, Column) else F.lit(mid_lat)
    judged = _judged(features)
    if "holes" not in features.columns:
        judged = judged.withColumn("holes", F.array().cast(RINGS))
    flags = F.when(has_tag(F.col("tags"), PARTIAL), F.array(F.lit("node.geometry.partial"))).otherwise(F.array().cast("array<string>"))
    nodes = judged.filter("reason is null").select(
        "region_key", "node_type", "subtype", F.coalesce("computed.name", F.lit("")).alias("name"), F.coalesce("osm_id", F.lit(0)).cast("long").alias("osm_id"),
        "tags", "is_area", "points", F.coalesce("holes", F.array().cast(RINGS)).alias("holes"), F.col("computed.height_m").alias("_height"), F.col("computed.width_m").alias("_width"), flags.alias("flags"),
    )
    source = F.when(F.col("osm_id") == 0, _shape())  # null for others, which then does not change the hash
    nodes = nodes.withColumn("node_id", node_key(F.col("region_key"), F.col("node_type"), F.col("osm_id"), source))
    nodes = _told_apart(nodes).withColumn("_own", shape_metrics(F.col("points"), F.col("is_area"), mid))
    metrics = F.struct(
        F.col("_own.area_m2").alias("area_m2"), F.col("_own.length_m").alias("length_m"), F.col("_own.centroid").alias("centroid"),
        F.col("_height").alias("height_m"), F.col("_width").alias("width_m"),
        F.lit(None).cast("double").alias("min_elev"), F.lit(None).cast("double").alias("max_elev"),
    )
    return nodes.select("region_key", "node_id", "node_type", "subtype", "name", "osm_id", "tags", "is_area", "points", "holes", metrics.alias("metrics"), "flags"), graph_rejections(features)


def list_nodes(features: DataFrame) -> DataFrame:
    """region_key, node_id, node_type, subtype, name, osm_id, is_area, flags of the nodes of features (list_features, with region_key), for those
    who read no shapes, tags or metrics. Ids are those of graph_nodes, but for features that share region, type and source id, or have
    no source id: these are told apart by what is listed, and equal ones by a count."""
    flags = F.when(F.col("partial"), F.array(F.lit("node.geometry.partial"))).otherwise(F.array().cast("array<string>"))
    own = _judged(features).filter("reason is null").select("region_key", "node_type", "subtype", "name", F.coalesce("osm_id", F.lit(0)).cast("long").alias("osm_id"), "is_area", "n_points", flags.alias("flags"))
    shape = F.xxhash64("subtype", "name", "is_area", "n_points", "flags")
    own = own.withColumn("node_id", node_key(F.col("region_key"), F.col("node_type"), F.col("osm_id"), F.when(F.col("osm_id") == 0, shape)))
    return _told_apart(cut(own), shape).select("region_key", "node_id", "node_type", "subtype", "name", "osm_id", "is_area", "flags")


def terrain_nodes(tiles: DataFrame, stats: DataFrame, regions: DataFrame) -> DataFrame:
    """A node for each raster in each region that it covers a part of: its footprint, area (at the middle latitude of the region) and
    elevation range."""
    met = dem_coverage(tiles, regions).filter("covered > 0").select("tile_id", "region_key")
    middle = regions.select("region_key", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("mid_lat"))
    own = tile_bounds(tiles).join(stats.select("tile_id", "min_elev", "max_elev"), "tile_id", "left").join(met, "tile_id").join(middle, "region_key")
    corner = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
    ring = F.array(corner("min_lat", "min_lon"), corner("max_lat", "min_lon"), corner("max_lat", "max_lon"), corner("min_lat", "max_lon"))
    metrics = F.struct(ring_area_m2(F.col("points"), F.col("mid_lat")).alias("area_m2"), ring_length_m(F.col("points"), F.col("mid_lat"), True).alias("length_m"), ring_centroid(F.col("points")).alias("centroid"), F.lit(0.0).alias("height_m"), F.lit(0.0).alias("width_m"), "min_elev", "max_elev")
    tags = F.create_map(F.lit("citygeo:dem_width"), F.col("width").cast("string"), F.lit("citygeo:dem_height"), F.col("height").cast("string"), F.lit("citygeo:dem_arcseconds"), F.round("arc_seconds", 6).cast("string"), F.lit("citygeo:dem_path"), F.col("tile_id"))
    flags = F.when(F.coalesce(F.col("max_elev") - F.col("min_elev"), F.lit(0.0)) <= 0, F.array(F.lit("node.terrain.norelief"))).otherwise(F.array().cast("array<string>"))
    own = own.withColumn("points", ring)
    kind = F.lit("TerrainTile")
    return own.select("region_key", node_key(F.col("region_key"), kind, F.col("tile_id")).alias("node_id"), kind.alias("node_type"), F.lit("dem").alias("subtype"), F.col("tile_id").alias("name"), F.lit(0).cast("long").alias("osm_id"), tags.alias("tags"), F.lit(True).alias("is_area"), "points", F.array().cast(RINGS).alias("holes"), metrics.alias("metrics"), flags.alias("flags"))


def road_points(nodes: DataFrame) -> DataFrame:
    """region_key, node_id and quantised coordinate (1e-7 degrees) of every vertex of a road."""
    own = nodes.filter("node_type = 'RoadSegment'").select("region_key", "node_id", F.explode("points").alias("p"))
    q = lambda k: F.floor(F.col(f"p.{k}") * 1e7 + 0.5).cast("long").alias(f"q{k}")
    return own.select("region_key", "node_id", q("lat"), q("lon")).distinct()


def junction_members(points: DataFrame) -> DataFrame:
    """region_key, junction_id, qlat, qlon and road (node_id), a row for each road of each junction: places on two roads or more."""
    at = ["region_key", "qlat", "qlon"]
    places = points.groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1")
    key = node_key(F.col("region_key"), F.lit("Junction"), F.col("qlat"), F.col("qlon"))
    return points.join(places, at).select(*at, key.alias("junction_id"), F.col("node_id").alias("road"), F.col("n").alias("n_roads"))


def junctions(members: DataFrame) -> DataFrame:
    """Junction nodes."""
    places = members.select("region_key", "junction_id", "qlat", "qlon").distinct()
    point = F.struct((F.col("qlat") / 1e7).alias("lat"), (F.col("qlon") / 1e7).alias("lon"))
    metrics = F.struct(F.lit(0.0).alias("area_m2"), F.lit(0.0).alias("length_m"), point.alias("centroid"), F.lit(0.0).alias("height_m"), F.lit(0.0).alias("width_m"), F.lit(None).cast("double").alias("min_elev"), F.lit(None).cast("double").alias("max_elev"))
    return places.select("region_key", F.col("junction_id").alias("node_id"), F.lit("Junction").alias("node_type"), F.lit("junction").alias("subtype"), F.lit("").alias("name"), F.lit(0).cast("long").alias("osm_id"), F.create_map().cast("map<string,string>").alias("tags"), F.lit(False).alias("is_area"), F.array(point).alias("points"), F.array().cast(RINGS).alias("holes"), metrics.alias("metrics"), F.array().cast("array<string>").alias("flags"))


def _edge(kind: str, src: Column, dst: Column, value: Column | None = None, tolerance: float = 0.0) -> list[Column]:
    return [F.col("region_key"), F.lit(kind).alias("edge_type"), src.alias("src"), dst.alias("dst"), (F.lit(0.0) if value is None else value).alias("value"), F.lit(tolerance).alias("tolerance_m")]


def shares_node_edges(members: DataFrame) -> DataFrame:
    return members.select(*_edge("SharesNode", F.col("road"), F.col("junction_id")))


def junction_classes(members: DataFrame) -> DataFrame:
    """region_key, junction_id, n_roads and n_pairs (ConnectsTo edges): one row a junction, however many roads meet there."""
    return members.groupBy("region_key", "junction_id").agg(F.count("*").alias("n_roads")).withColumn("n_pairs", F.expr("n_roads * (n_roads - 1) div 2"))


def connects_to_edges(members: DataFrame, most: int = HUB_ROADS) -> DataFrame:
    """An edge for each unordered pair of roads at each junction: the result itself has one row a pair, by definition. At a hub the first
    roads of the pairs are dealt into shares of about ``most``, and each share meets all roads, so a hub's pairs are made in many tasks."""
    own = members.select("region_key", "junction_id", "road", F.ceil(F.col("n_roads") / most).cast("int").alias("_shares"))
    first = own.withColumn("_share", F.pmod(F.xxhash64("road"), F.col("_shares")).cast("int"))
    second = own.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    pairs = first.alias("a").join(second.alias("b"), ["region_key", "junction_id", "_share"]).filter("a.road < b.road")
    return pairs.select(*_edge("ConnectsTo", F.col("a.road"), F.col("b.road")))


def road_pairs(points: DataFrame, most: int = HUB_ROADS) -> DataFrame:
    """region_key, a, b (roads, a < b) and places: how many they share, a row for each pair of roads that meet. points: road_points.

    Roads of equal places are taken together, so a pair of such shapes is looked at once for all roads that have them, and only at the
    first of the places that both have: no pair is made twice, and none is grouped or moved. Hubs are dealt as in connects_to_edges.
    """
    place = F.col("qlat") * 4294967296 + F.col("qlon") + 1_800_000_000  # exact: 31 and 32 bits
    roads = points.groupBy("region_key", "node_id").agg(F.array_sort(F.collect_set(place)).alias("places"))
    shapes = gathered(roads, ["region_key", "places"], "node_id").withColumn("own", F.array_min("ids"))
    met = cut(shapes.withColumn("place", F.explode("places")))
    at = ["region_key", "place"]
    hubs = met.groupBy(*at).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    met = met.join(hubs, at, "left").withColumn("_shares", F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)).cast("int")).drop("_n")
    first = met.withColumn("_share", F.pmod(F.xxhash64("own"), F.col("_shares")).cast("int"))
    second = met.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    keys = [*at, "_share"]
    pairs = spread(first, *keys).alias("a").join(spread(second, *keys).alias("b"), keys).filter("a.own <= b.own")
    # exploded from an array of one, so that it is made once
    both = pairs.select("region_key", "place", F.col("a.own").alias("_a"), F.col("b.own").alias("_b"), F.col("a.ids").alias("_a_ids"), F.col("b.ids").alias("_b_ids"), F.explode(F.array(F.array_intersect("a.places", "b.places"))).alias("_both"))
    both = both.filter(F.array_min("_both") == F.col("place")).select("region_key", "_a", "_b", "_b_ids", F.size("_both").cast("long").alias("places"), F.explode("_a_ids").alias("_x"))
    named = both.select("region_key", "_a", "_b", "places", "_x", F.explode("_b_ids").alias("_y")).filter("_a <> _b or _x < _y")
    return named.select("region_key", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "places")


def contains_pairs(nodes: DataFrame) -> DataFrame:
    """region_key, zones and buildings (arrays of ids): each zone of a row contains each building of it, and each pair is in one row.

    Zones of one shape are taken together, and buildings of one centroid, so a pair of them is tested once. They meet in an equi-join
    on cells of about the zone's size; then come its box and the even-odd test, holes excluded."""
    low = lambda k: F.array_min(F.transform("points", lambda p: p[k]))
    high = lambda k: F.array_max(F.transform("points", lambda p: p[k]))
    own = nodes.filter(F.col("node_type").isin(ZONES) & F.col("is_area"))
    zones = gathered(own, ["region_key", "points", "holes"], "node_id").withColumnRenamed("ids", "zones")
    zones = zones.withColumns({f"_{n}_{k}": f(k) for n, f in (("low", low), ("high", high)) for k in ("lat", "lon")})
    extent = F.greatest(F.col("_high_lat") - F.col("_low_lat"), F.col("_high_lon") - F.col("_low_lon"))
    fits = F.filter(F.array(*[F.lit(s) for s in ZONE_CELLS_DEG]), lambda s: s >= extent)
    zones = zones.withColumn("_size", F.when(F.size(fits) > 0, fits[0]).otherwise(ZONE_CELLS_DEG[-1]))
    zones = box_cells(zones, *[F.col(c) for c in ("_low_lat", "_low_lon", "_high_lat", "_high_lon")], F.col("_size"), F.col("_size"))
    # kept, as joins on a centroid would make it again for each key and null test
    houses = cut(nodes.filter("node_type = 'Building'").select("region_key", "node_id", F.col("metrics.centroid.lat").alias("lat"), F.col("metrics.centroid.lon").alias("lon")))
    places = gathered(houses, ["region_key", "lat", "lon"], "node_id").withColumnRenamed("ids", "buildings")
    places = places.withColumn("_size", F.explode(F.array(*[F.lit(s) for s in ZONE_CELLS_DEG])))
    places = places.withColumns({"_row": cell(F.col("lat"), F.col("_size")), "_col": cell(F.col("lon"), F.col("_size"))})
    met = places.join(zones, ["region_key", "_size", "_row", "_col"]).filter("lat between _low_lat and _high_lat and lon between _low_lon and _high_lon")
    return met.filter(in_area(F.col("lat"), F.col("lon"), F.concat(F.array("points"), "holes"))).select("region_key", "zones", "buildings")


def contains_edges(nodes: DataFrame) -> DataFrame:
    """Zone → building whose centroid lies in the zone and in none of its holes: a row for each pair."""
    pairs = spread(contains_pairs(nodes), "zones", "buildings")
    pairs = pairs.select("region_key", "buildings", F.explode("zones").alias("zone")).select("region_key", "zone", F.explode("buildings").alias("building"))
    return pairs.select(*_edge("Contains", F.col("zone"), F.col("building")))


def in_area(lat: Column, lon: Column, rings: Column) -> Column:
    """In the first ring and in no other (holes)."""
    return point_in_ring(lat, lon, rings[0]) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda hole: point_in_ring(lat, lon, hole))


def _nearest_roads(places: DataFrame, roads: DataFrame, mid_lat: float, reach_m: float) -> DataFrame:
    """region_key, lat, lon, best (d, road) of places with a road within the reach, ties to the least road id. Roads are rowed by
    the cells their segments cross, places by nine cells of the reach's size: all pairs within it share a cell."""
    size = max(reach_m, LEAST_CELL_M)
    lat_size, lon_size = size / M_PER_DEGREE, size / max(1.0, M_PER_DEGREE * math.cos(math.radians(mid_lat)))
    keys = ["region_key", "_row", "_col"]
    own = spread(around(places, F.col("lat"), F.col("lon"), lat_size, lon_size), *keys)
    met = own.join(spread(segment_cells(roads, F.col("s.a"), F.col("s.b"), lat_size, lon_size), *keys), keys)
    met = met.withColumn("d", point_segment_m(F.col("lat"), F.col("lon"), F.col("s.a"), F.col("s.b"), F.lit(mid_lat))).filter(F.col("d") <= reach_m)
    return met.groupBy("region_key", "lat", "lon").agg(F.min(F.struct("d", "road")).alias("best"))  # pairs met twice have equal distances


def fronts_onto_edges(nodes: DataFrame, mid_lat: float, cutoff_m: float = CUTOFF_M) -> DataFrame:
    """Building → nearest road within the cutoff, ties to the least road id.

    A road found within a small reach is the nearest of all, so only buildings without one look as far as the cutoff: in dense
    towns few pairs are measured, in sparse ones few there are. Buildings of one centroid are looked up once, and of equal segments
    only that of the least road id, which wins among them.
    """
    roads = nodes.filter("node_type = 'RoadSegment'").select("region_key", F.col("node_id").alias("road"), F.explode(F.expr("transform(sequence(0, size(points) - 2), i -> struct(points[i] as a, points[i + 1] as b))")).alias("s"))
    roads = cut(roads.groupBy("region_key", "s").agg(F.min("road").alias("road")))
    own = cut(nodes.filter("node_type = 'Building'").select("region_key", F.col("node_id").alias("building"), F.col("metrics.centroid.lat").alias("lat"), F.col("metrics.centroid.lon").alias("lon")))
    at = ["region_key", "lat", "lon"]
    places = cut(own.select(*at).distinct())
    best = _nearest_roads(places, roads, mid_lat, min(cutoff_m, LEAST_CELL_M))
    if cutoff_m > LEAST_CELL_M:
        best = cut(best)
        rest = places.join(best.select(*at), at, "left_anti")
        best = best.unionByName(_nearest_roads(rest, roads, mid_lat, cutoff_m))
    return own.join(best, at).select(*_edge("FrontsOnto", F.col("building"), F.col("best.road"), F.col("best.d"), cutoff_m))


def no_street(nodes: DataFrame, fronts: DataFrame) -> DataFrame:
    """Buildings without a FrontsOnto edge: region_key, node_id."""
    own = nodes.filter("node_type = 'Building'").select("region_key", "node_id")
    return own.join(fronts.select("region_key", F.col("src").alias("node_id")), ["region_key", "node_id"], "left_anti")


def plural(name: Column) -> Column:
    return F.when(name.rlike("[^aeiou]y$"), F.regexp_replace(name, "y$", "ies")).otherwise(F.concat(name, F.lit("s")))


def group_members(nodes: DataFrame, corridors: bool = True) -> DataFrame:
    """region_key, kind, name, node_type, node_id: the long form of groups, for groups of any size."""
    by_type = nodes.select("region_key", F.lit("Category").alias("kind"), plural(case_of(F.col("node_type"), NODE_NAMES, "Unknown")).alias("name"), "node_type", "node_id")
    if not corridors:
        return by_type
    roads = nodes.filter("node_type = 'RoadSegment' and name <> ''")
    several = roads.groupBy("region_key", "name").count().filter("count > 1").select("region_key", "name")
    own = roads.join(several, ["region_key", "name"]).select("region_key", F.lit("Corridor").alias("kind"), "name", "node_type", "node_id")
    return by_type.unionByName(own)


def with_corridors(nodes: DataFrame, most: int = MOST_FEW) -> DataFrame:
    """Adds corridor: the name of a road that shares it with another of its region, else null. Up to ``most`` names are broadcast."""
    road = (F.col("node_type") == "RoadSegment") & (F.col("name") != "")
    names = cut(nodes.filter(road).groupBy("region_key", "name").agg(F.count("*").alias("_n")).filter("_n > 1").select("region_key", F.col("name").alias("corridor")))
    if names.count() <= most:
        same = (F.col("_own.region_key") == F.col("_names.region_key")) & road & (F.col("_own.name") == F.col("corridor"))
        return nodes.alias("_own").join(F.broadcast(names.alias("_names")), same, "left").select("_own.*", "corridor")
    named = nodes.filter(road).select("region_key", "node_id", F.col("name").alias("corridor")).join(names, ["region_key", "corridor"])
    return nodes.join(named, ["region_key", "node_id"], "left").select(*nodes.columns, "corridor")  # on ids, which others than roads have too


def graph_groups(members: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """Groups as chunks: region_key, kind, name, node_type, size (of the group), first (members before the chunk) and node_ids (sorted, at
    most ``most``); chunks in the order of first make up the group. A group is cut by ranges of ids before it is gathered, so a
    task holds about half a chunk of it, if ids are spread as hashes are."""
    keys = ["region_key", "kind", "name", "node_type"]
    sizes = members.groupBy(*keys).agg(F.count("*").alias("size"), F.min("node_id").cast("double").alias("_low"), F.max("node_id").cast("double").alias("_high"))
    ranges = F.ceil(F.col("size") * 2 / most)
    share = F.try_divide(F.col("node_id").cast("double") - F.col("_low"), F.col("_high") - F.col("_low"))
    dealt = members.join(sizes, keys).withColumn("_range", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * ranges), ranges - 1))
    parts = dealt.groupBy(*keys, "size", "_range").agg(F.sort_array(F.collect_list("node_id")).alias("_ids"))
    before = F.sum(F.size("_ids")).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    chunks = F.transform(F.sequence(F.lit(0), F.size("_ids") - 1, F.lit(most)), lambda i: F.struct(i.alias("at"), F.slice("_ids", i + 1, most).alias("ids")))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("c", F.explode(chunks))
    return parts.select(*keys, "size", (F.col("_before") + F.col("c.at")).alias("first"), F.col("c.ids").alias("node_ids"))


def category_groups(nodes: DataFrame) -> DataFrame:
    return graph_groups(group_members(nodes, corridors=False))


def corridors(nodes: DataFrame) -> DataFrame:
    return graph_groups(group_members(nodes).filter("kind = 'Corridor'"))


def validate_nodes(nodes: DataFrame, edges: DataFrame, regions: DataFrame, margin: float = CLIP_MARGIN) -> DataFrame:
    """Nodes with their flags: duplicate source id (all but the least node id), degenerate or empty geometry, outside the region
    (terrain apart), road without junction, building without street."""
    marks = ["_first", "_joined", "_fronted"]
    mark = lambda df, col, name: df.select("region_key", F.col(col).alias("node_id"), *[F.lit(m == name).alias(m) for m in marks])
    # the first of each source id is met by its own id: nodes without one share the source id 0, which is then no key at all
    first = nodes.filter("osm_id <> 0").groupBy("region_key", "osm_id").agg(F.min("node_id").alias("node_id"))
    found = mark(first, "node_id", "_first").unionByName(mark(edges.filter("edge_type = 'SharesNode'"), "src", "_joined")).unionByName(mark(edges.filter("edge_type = 'FrontsOnto'"), "src", "_fronted"))
    found = found.groupBy("region_key", "node_id").agg(*[F.bool_or(m).alias(m) for m in marks])
    box = regions.select("region_key", *[(F.col(c) + s * margin).alias(f"_{c}") for c, s in (("min_lat", -1), ("min_lon", -1), ("max_lat", 1), ("max_lon", 1))])
    own = nodes.join(few(cut(box)), "region_key", "left")  # counted, as a region would else gather all its nodes in one task
    n, area, length = F.size("points"), F.col("metrics.area_m2"), F.col("metrics.length_m")
    off = F.exists("points", lambda p: (p["lat"] < F.col("_min_lat")) | (p["lat"] > F.col("_max_lat")) | (p["lon"] < F.col("_min_lon")) | (p["lon"] > F.col("_max_lon")))
    shape = ~F.col("node_type").isin("Junction")
    short = shape & (n > 0) & (n < F.when(F.col("is_area"), 3).otherwise(2))
    # what a node's own shape says is told before it meets the marks, so that readers of flags alone move no shapes
    checks = [
        (shape & (n == 0), "node.geometry.missing"),
        (short, "node.geometry.degenerate"),
        (shape & ~short & (n > 0) & F.col("is_area") & (area <= 0), "node.geometry.zeroarea"),
        (shape & ~short & (n > 0) & ~F.col("is_area") & (length <= 0), "node.geometry.zerolength"),
        ((F.col("node_type") != "TerrainTile") & off, "node.geometry.outsideregion"),
    ]
    met = [
        ((F.col("node_type") == "RoadSegment") & ~F.col("_joined"), "node.road.nojunction"),
        ((F.col("node_type") == "Building") & ~F.col("_fronted"), "node.building.nostreet"),
    ]
    codes = lambda pairs: [F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in pairs]
    own = own.select(*nodes.columns, F.array_compact(F.array(*codes(checks))).alias("_shaped")).join(found, ["region_key", "node_id"], "left").fillna(False, marks)
    twin = codes([((F.col("osm_id") != 0) & ~F.col("_first"), "node.osmid.duplicate")])
    found = F.concat("flags", F.array_compact(F.array(*twin)), "_shaped", F.array_compact(F.array(*codes(met))))
    return own.withColumn("flags", F.array_distinct(found)).select(nodes.columns)


def flag_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select("region_key", F.explode("flags").alias("flag")).groupBy("region_key", "flag").count()


def graph_report(nodes: DataFrame, n_considered: DataFrame, n_rejected: DataFrame) -> DataFrame:
    """Issues of the graph. n_considered and n_rejected: (region_key, n). Nodes made from features and rejections must make up
    all features considered."""
    flagged = [F.count_if(F.array_contains("flags", flag)).alias(flag) for flag, *_ in _REPORT]
    made = nodes.groupBy("region_key").agg(F.count_if(~F.col("node_type").isin("Junction", "TerrainTile")).alias("_made"), *flagged)
    all_in = n_considered.withColumnRenamed("n", "_considered").join(made, "region_key", "left").join(n_rejected.withColumnRenamed("n", "_rejected"), "region_key", "left").na.fill(0)
    own = [issue(F.col(f"`{flag}`") > 0, F.col("region_key"), severity, code, F.format_string(f"%d {text}", F.col(f"`{flag}`"))) for flag, severity, code, text in _REPORT]
    lost = issue(F.col("_made") + F.col("_rejected") < F.col("_considered"), F.col("region_key"), "Fatal", "graph.features.unaccounted", "features are neither nodes nor rejected")
    return issues_of(all_in, *own, lost)


_REPORT = [
    ("node.geometry.outsideregion", "Fatal", "graph.geometry.outsideregion", "nodes lie outside the region"),
    ("node.geometry.degenerate", "Warning", "graph.geometry.degenerate", "nodes have degenerate geometry"),
    ("node.osmid.duplicate", "Warning", "graph.osmid.duplicate", "nodes share a source id"),
    ("node.road.nojunction", "Warning", "graph.road.nojunction", "roads meet no other road"),
    ("node.building.nostreet", "Warning", "graph.building.nostreet", "buildings have no street"),
]


def with_content(nodes: DataFrame) -> DataFrame:
    """Adds content: a hash of what a node is, flags apart. Made before flags are found, it moves in place of shapes and tags."""
    shape = F.transform("points", lambda p: F.format_string("%.9f,%.9f", p["lat"], p["lon"]))
    return nodes.withColumn("content", F.xxhash64("node_type", "subtype", "name", "osm_id", F.concat_ws(";", shape), F.to_json("holes"), F.to_json(F.array_sort(F.map_entries("tags")))))


def graph_fingerprint(nodes: DataFrame, edges: DataFrame, members: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """One digest for each region, equal for equal graphs in any order: counts, sums and xors of row hashes. Junctions given as members
    are told by all roads that meet there, a row each; edges need then not hold their ConnectsTo edges, which say the same in pairs.
    Contains edges given as held (contains_pairs) are told by the sums, over all pairs, of products of two hashes of zone and building:
    these follow from sums over a row's zones and its buildings, so no pair is made, however the pairs are dealt into rows."""
    own = nodes if "content" in nodes.columns else with_content(nodes)
    rows = own.select("region_key", F.xxhash64(F.lit("node"), "node_id", "content", F.concat_ws(";", F.array_sort("flags"))).alias("h"))
    rows = rows.unionByName(edges.select("region_key", F.xxhash64(F.lit("edge"), "edge_type", "src", "dst", F.when(F.col("value") == 0, "0.000000").otherwise(F.format_string("%.6f", "value"))).alias("h")))
    if held is not None:
        below = lambda c: F.pmod(c, F.lit(PRIME))
        total = lambda ids, k: below(F.aggregate(ids, F.lit(0).cast("long"), lambda a, i: a + below(F.xxhash64(F.lit(f"{ids} {k}"), i))))
        sums = [F.sum(below(total("zones", k) * total("buildings", k))).alias(f"s{k}") for k in (0, 1)]
        pairs = held.groupBy("region_key").agg(F.sum(F.size("zones").cast("long") * F.size("buildings")).alias("n"), *sums)
        rows = rows.unionByName(pairs.select("region_key", F.xxhash64(F.lit("contains"), "n", below(F.col("s0")), below(F.col("s1"))).alias("h")))
    if members is not None:
        road = F.xxhash64("road")
        met = members.groupBy("region_key", "junction_id").agg(F.count("*").alias("n"), F.sum(road.cast("decimal(38,0)")).alias("s"), F.bit_xor(road).alias("x"))
        rows = rows.unionByName(met.select("region_key", F.xxhash64(F.lit("junction"), "junction_id", "n", F.col("s").cast("string"), "x").alias("h")))
    total = rows.groupBy("region_key").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"))
    return total.select("region_key", F.md5(F.concat_ws("|", "n", "s", "x")).alias("fingerprint"))


def build_city_graph(features: DataFrame, regions: DataFrame, mid_lat: float, options: GraphOptions | None = None, terrain: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, edges, members (groups in long form), rejections and issues of clipped features, and of terrain (terrain_nodes)."""
    options = options or GraphOptions()
    features = cut(features)
    nodes, rejected = _nodes_of(features, mid_lat)
    members = cut(junction_members(road_points(nodes)))
    links = shares_node_edges(members)
    if options.fronts_onto:
        links = links.unionByName(cut(fronts_onto_edges(nodes, mid_lat, options.cutoff_m)))
    edges = links.unionByName(connects_to_edges(members))  # pairs are made when they are read: no flag depends on them
    if options.contains:
        edges = edges.unionByName(contains_edges(nodes))
    every = nodes.unionByName(junctions(members))
    every = every if terrain is None else every.unionByName(terrain)
    flagged = validate_nodes(every, links, regions)
    count = lambda df: df.groupBy("region_key").agg(F.count("*").alias("n"))
    return {"nodes": flagged, "edges": edges, "members": group_members(every, options.corridors), "rejections": rejected, "issues": graph_report(flagged, count(features), count(rejected))}


def geom_points(nodes: DataFrame) -> DataFrame:
    """Long form of geometry: region_key, node_id, ring_no (0 for a line or the outer ring), seq, lat, lon."""
    rings = nodes.select("region_key", "node_id", F.posexplode(F.concat(F.array("points"), "holes")).alias("ring_no", "ring"))
    return rings.select("region_key", "node_id", "ring_no", F.posexplode("ring").alias("seq", "p")).select("region_key", "node_id", "ring_no", "seq", "p.lat", "p.lon")


def geom_ring(nodes: DataFrame, ring_no: int) -> DataFrame:
    """region_key, node_id and one ring of each node that has so many."""
    ring = F.try_element_at(F.concat(F.array("points"), "holes"), F.lit(ring_no + 1))
    return nodes.select("region_key", "node_id", ring.alias("ring")).filter("ring is not null")


def geom_bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("region_key", "node_id").agg(F.countDistinct("ring_no").alias("rings"), F.count("*").alias("points"), F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))
