"""Ways and nodes to features: resolve, classify, measure, clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citygeo.functions.geo import CLIP_MARGIN, KM_PER_DEGREE
from citygeo.functions.numbers import clamp
from citygeo.functions.tags import PARTIAL, building_height, classify, feature_name, has_tag, road_props
from citygeo.operators.spatial import cell, place_cells, sized_cells

EMPTY_POINTS = "array<struct<lat: double, lon: double>>"


def resolve_ways(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, points (in order, missing nodes skipped), n_refs, n_missing, closed (first ref equals last, two refs at least).

    way_nodes: (way_id, seq, node_id). One hash join on the node id and one grouping on the way id.
    """
    own = way_nodes.select("way_id", "seq", "node_id").join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id", "left")
    item = F.struct("seq", "lat", "lon")
    grouped = own.groupBy("way_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("lat").isNotNull(), item))).alias("items"),
        F.count("*").alias("n_refs"),
        F.count_if(F.col("lat").isNull()).alias("n_missing"),
        F.min_by("node_id", "seq").alias("first_ref"),
        F.max_by("node_id", "seq").alias("last_ref"),
    )
    points = F.transform("items", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return grouped.select("way_id", points.alias("points"), "n_refs", "n_missing", ((F.col("first_ref") == F.col("last_ref")) & (F.col("n_refs") >= 2)).alias("closed"))


def way_states(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, n_points, n_refs, n_missing, closed: resolve_ways for those who read no points, as counts."""
    own = way_nodes.select("way_id", "seq", "node_id").join(nodes.select(F.col("id").alias("node_id"), F.col("lat").isNotNull().alias("found")), "node_id", "left")
    ends = [F.min_by("node_id", "seq").alias("first_ref"), F.max_by("node_id", "seq").alias("last_ref")]
    grouped = own.groupBy("way_id").agg(F.count_if("found").alias("n_points"), F.count("*").alias("n_refs"), *ends)
    return grouped.select("way_id", "n_points", "n_refs", (F.col("n_refs") - F.col("n_points")).alias("n_missing"), ((F.col("first_ref") == F.col("last_ref")) & (F.col("n_refs") >= 2)).alias("closed"))


def way_stats(resolved: DataFrame) -> DataFrame:
    """way_id, closed, n_refs, and the mean of the vertices: (0, 0) if any is missing. A closed way counts its last point too."""
    mean = lambda k: F.when((F.col("n_missing") == 0) & (F.size("points") > 0), F.aggregate("points", F.lit(0.0), lambda a, p: a + p[k]) / F.size("points")).otherwise(0.0)
    return resolved.select("way_id", "closed", "n_refs", mean("lat").alias("mean_lat"), mean("lon").alias("mean_lon"))


def usable_ways(resolved: DataFrame) -> DataFrame:
    """Adds usable (3 points if closed, else 2) and partial (usable, with nodes missing)."""
    n = F.col("n_points") if "n_points" in resolved.columns else F.size("points")
    usable = n >= F.when(F.col("closed"), 3).otherwise(2)
    return resolved.withColumns({"usable": usable, "partial": usable & (F.col("n_missing") > 0)})


def usable_counts(resolved: DataFrame) -> DataFrame:
    return usable_ways(resolved).agg(F.count("*").alias("ways"), F.count_if("usable").alias("usable"), F.count_if("partial").alias("partial"), F.count_if(~F.col("usable")).alias("skipped"))


def typed_ways(tags: DataFrame, types: list[str] | None = None) -> DataFrame:
    """way_id, tags, feature_type, subtype of the ways that a rule fits, of all types or of the given ones."""
    # exploded from an array of one, so that it is made once
    typed = tags.withColumn("kind", F.explode(F.array(classify(F.col("tags"))))).filter("kind is not null").select("way_id", "tags", "kind.feature_type", "kind.subtype")
    return typed if types is None else typed.filter(F.col("feature_type").isin(types))


def list_features(way_nodes: DataFrame, nodes: DataFrame, tags: DataFrame, types: list[str] | None = None) -> DataFrame:
    """osm_id, feature_type, subtype, is_area, n_points, name, partial (the way's own, or by its tags) of the features that build_features
    gives, for those who read neither points nor tags: ways are counted, not gathered, and no tags are moved."""
    typed = typed_ways(tags, types).select("way_id", "feature_type", "subtype", feature_name(F.col("tags")).alias("name"), has_tag(F.col("tags"), PARTIAL).alias("_marked"))
    ways = usable_ways(way_states(way_nodes, nodes)).filter("usable").join(typed, "way_id")
    return ways.select(F.col("way_id").alias("osm_id"), "feature_type", "subtype", F.col("closed").alias("is_area"), "n_points", "name", (F.col("partial") | F.col("_marked")).alias("partial"))


def build_features(way_nodes: DataFrame, nodes: DataFrame, tags: DataFrame, types: list[str] | None = None) -> DataFrame:
    """osm_id, feature_type, subtype, is_area, points, tags, computed, partial. tags: (way_id, tags). Of all types, or of the given ones:
    way_nodes need then hold no other ways than theirs (typed_ways), which spares the looking up of nodes.

    Ways that no rule fits and unusable ways give no feature. A partial way gains a tag. Tags are read once, and meet the ways on the key
    that these are grouped by.
    """
    typed = typed_ways(tags, types)
    ways = usable_ways(resolve_ways(way_nodes, nodes)).filter("usable").join(typed, "way_id")
    all_tags = F.when(F.col("partial"), F.map_concat(F.map_filter("tags", lambda k, _: k != PARTIAL), F.create_map(F.lit(PARTIAL), F.lit("true")))).otherwise(F.col("tags"))
    sub = F.col("subtype")
    house = F.when(F.col("feature_type") == "Building", building_height(F.col("tags"), sub))
    road = F.when(F.col("feature_type") == "Highway", road_props(F.col("tags"), sub))
    own = ways.withColumns({"_house": house, "_road": road})
    or_else = lambda c, v: F.coalesce(c, F.lit(v))
    computed = F.struct(
        or_else(F.col("_house.height_m"), 0.0).alias("height_m"), or_else(F.col("_house.levels"), 0).alias("levels"), or_else(F.col("_house.from_tags"), False).alias("height_from_tags"),
        or_else(F.col("_road.width_m"), 0.0).alias("width_m"), or_else(F.col("_road.lanes"), 0).alias("lanes"), or_else(F.col("_road.oneway"), False).alias("oneway"),
        feature_name(F.col("tags")).alias("name"),
    )
    return own.select(F.col("way_id").alias("osm_id"), "feature_type", "subtype", F.col("closed").alias("is_area"), "points", all_tags.alias("tags"), computed.alias("computed"), "partial")


def clip_features(features: DataFrame, regions: DataFrame, margin: float = CLIP_MARGIN) -> DataFrame:
    """Features with a point in a region's padded box, their points moved into it, with region_key.

    A feature meets regions by the cells of its points, so the join is an equi-join; Spark's size check decides on broadcasting.
    """
    box = regions.select("region_key", *[(F.col(c) + s * margin).alias(f"_{c}") for c, s in (("min_lat", -1), ("min_lon", -1), ("max_lat", 1), ("max_lon", 1))])
    box = sized_cells(box, *[F.col(c) for c in ("_min_lat", "_min_lon", "_max_lat", "_max_lon")])
    cells = F.array_distinct(F.flatten(F.transform("points", lambda p: place_cells(p["lat"], p["lon"]))))
    own = features.withColumn("_at", F.explode(cells)).withColumns({"_size": F.col("_at.size"), "_row": F.col("_at.row"), "_col": F.col("_at.col")}).drop("_at")
    found = own.join(box, ["_size", "_row", "_col"])
    near = lambda p: p["lat"].between(F.col("_min_lat"), F.col("_max_lat")) & p["lon"].between(F.col("_min_lon"), F.col("_max_lon"))
    at = lambda p: F.struct(cell(p["lat"], F.col("_size")).alias("row"), cell(p["lon"], F.col("_size")).alias("col"))
    first = F.array_min(F.transform(F.filter("points", near), at))
    found = found.filter(F.exists("points", near) & (F.struct("_row", "_col") == first))  # a feature that meets a region in several cells counts once
    into = lambda p: F.struct(clamp(p["lat"], F.col("_min_lat"), F.col("_max_lat")).alias("lat"), clamp(p["lon"], F.col("_min_lon"), F.col("_max_lon")).alias("lon"))
    if "holes" in features.columns:
        found = found.withColumn("holes", F.transform("holes", lambda ring: F.transform(ring, into)))
    return found.withColumn("points", F.transform("points", into)).drop("_size", "_row", "_col", "_min_lat", "_min_lon", "_max_lat", "_max_lon")


def _range(k: str) -> tuple[Column, Column]:
    own = F.transform("points", lambda p: p[k])
    return F.array_min(own), F.array_max(own)


def feature_bbox(features: DataFrame) -> DataFrame:
    """Adds the axis-aligned box of each feature."""
    (a, c), (b, d) = _range("lat"), _range("lon")
    return features.withColumns({"min_lat": a, "min_lon": b, "max_lat": c, "max_lon": d})


def feature_bounds(features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bounds over every point, mid-point, and extent in degrees and kilometres."""
    own = feature_bbox(features).groupBy(*(by or [])).agg(F.min("min_lat").alias("min_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lat").alias("max_lat"), F.max("max_lon").alias("max_lon"))
    mid = {"mid_lat": (F.col("min_lat") + F.col("max_lat")) / 2, "mid_lon": (F.col("min_lon") + F.col("max_lon")) / 2}
    extent = {"lat_deg": F.col("max_lat") - F.col("min_lat"), "lon_deg": F.col("max_lon") - F.col("min_lon")}
    return own.withColumns(mid | extent).withColumns({"height_km": F.col("lat_deg") * KM_PER_DEGREE, "width_km": F.col("lon_deg") * KM_PER_DEGREE * F.cos(F.radians("mid_lat"))})


def features_of_type(features: DataFrame, feature_type: str) -> DataFrame:
    return features.filter(F.col("feature_type") == feature_type)


def feature_by_id(features: DataFrame, ids: list[int]) -> DataFrame:
    return features.filter(F.col("osm_id").isin(ids))


def count_by_type(features: DataFrame) -> DataFrame:
    return features.groupBy("feature_type").agg(F.count("*").alias("features"), F.count_if("is_area").alias("areas"), F.count_if(has_tag(F.col("tags"), "name")).alias("named"))
