"""What tags say: feature type, subtype, building and road properties, relation type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citygeo.functions.numbers import case_of, leading_integer, leading_number

PARTIAL = "citygeo:partial_geometry"
# Key, required value (None: any), feature type; the first rule that fits wins.
RULES = [
    ("building", None, "Building"),
    ("building:part", None, "Building"),
    ("highway", None, "Highway"),
    ("railway", None, "Railway"),
    ("natural", "water", "WaterArea"),
    ("waterway", "riverbank", "WaterArea"),
    ("waterway", None, "Waterway"),
    ("natural", None, "NaturalArea"),
    ("landuse", None, "Landuse"),
    ("leisure", None, "Leisure"),
    ("amenity", None, "Amenity"),
    ("barrier", None, "Barrier"),
    ("boundary", "administrative", "Boundary"),
    ("power", None, "Power"),
]
# Heights (m) of buildings and widths (m) of roads that have none of their own.
HEIGHTS = {("house", "detached"): 8.0, "apartments": 18.0, "office": 30.0, "commercial": 15.0, ("garage", "shed"): 3.5}
OTHER_HEIGHT, FLOOR = 9.0, 3.0
WIDTHS = {"motorway": 14.0, "trunk": 12.0, "primary": 10.0, "secondary": 8.0, "tertiary": 7.0, "residential": 6.0, "service": 4.0, ("footway", "path"): 2.0}
OTHER_WIDTH = 6.0
RELATION_TYPES = {"multipolygon": "Multipolygon", "route": "Route", "boundary": "Boundary", "restriction": "Restriction", "building": "Building", "site": "Site"}


def has_tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def get_tag(tags: Column, key: str, default: str = "") -> Column:
    return F.coalesce(tags[key], F.lit(default))


def classify(tags: Column) -> Column:
    """struct(feature_type, subtype) of the first rule that fits; null if none does. The subtype is the tag's value."""
    fits = [(has_tag(tags, k) if v is None else has_tag(tags, k) & (tags[k] == v), k, t) for k, v, t in RULES]
    return F.coalesce(*[F.when(fit, F.struct(F.lit(t).alias("feature_type"), tags[k].alias("subtype"))) for fit, k, t in fits])


def building_height(tags: Column, subtype: Column) -> Column:
    """struct(height_m, levels, from_tags). A height tag that is no number does not fall through to building:height."""
    tagged = F.when(has_tag(tags, "height"), leading_number(tags["height"])).otherwise(leading_number(tags["building:height"]))
    levels = F.coalesce(leading_integer(tags["building:levels"]), F.lit(0))
    by_tag, by_levels = F.coalesce(tagged > 0, F.lit(False)), levels > 0
    height = F.when(by_tag, tagged).when(by_levels, levels * FLOOR).otherwise(case_of(subtype, HEIGHTS, OTHER_HEIGHT))
    return F.struct(height.alias("height_m"), levels.alias("levels"), (by_tag | by_levels).alias("from_tags"))


def road_props(tags: Column, subtype: Column) -> Column:
    """struct(width_m, lanes, oneway). Lanes do not widen a road."""
    tagged = leading_number(tags["width"])
    width = F.when(tagged > 0, tagged).otherwise(case_of(subtype, WIDTHS, OTHER_WIDTH))
    lanes = F.coalesce(leading_integer(tags["lanes"]), F.lit(0))
    return F.struct(width.alias("width_m"), lanes.alias("lanes"), F.coalesce(tags["oneway"].isin("yes", "true", "1"), F.lit(False)).alias("oneway"))


def feature_name(tags: Column) -> Column:
    return get_tag(tags, "name")


def relation_type(tags: Column) -> Column:
    """One of six named kinds, Other for another type tag, Unknown without one."""
    return F.when(~has_tag(tags, "type"), F.lit("Unknown")).otherwise(case_of(tags["type"], RELATION_TYPES, "Other"))


def members_by_role(members: Column, role: str, ways_only: bool = False) -> Column:
    """refs of members with the role, in order."""
    keep = F.filter(members, lambda m: (m["role"] == role) & ((m["type"] == "way") if ways_only else F.lit(True)))
    return F.transform(keep, lambda m: m["ref"])
