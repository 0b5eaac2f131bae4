"""Materials: tags and types to categories, physical constants, variants, palettes, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.functions.numbers import case_of, clamp, leading_integer
from citygeo.functions.tags import get_tag, has_tag

CATEGORIES = ["Unknown", "Concrete", "Brick", "Stone", "Metal", "Glass", "Wood", "Plastic", "Plaster", "Asphalt", "Soil", "Grass", "Vegetation", "Water", "CementBlock", "RoofTile"]
# Words of material tags and the category they mean.
WALL_WORDS = {
    ("brick", "bricks"): "Brick",
    ("concrete", "reinforced_concrete", "cement"): "Concrete",
    ("glass", "mirror"): "Glass",
    ("wood", "timber", "log"): "Wood",
    ("metal", "steel", "iron", "aluminium", "corrugated_iron", "tin"): "Metal",
    ("stone", "limestone", "sandstone", "granite", "marble", "rock", "rubblestone"): "Stone",
    ("plaster", "stucco", "render", "daub"): "Plaster",
    ("cement_block", "cinder_block", "concrete_blocks"): "CementBlock",
    ("plastic", "vinyl", "composite"): "Plastic",
    ("tiles", "clay"): "RoofTile",
}
ROOF_WORDS = {
    ("tiles", "clay", "ceramic", "tile", "roof_tiles"): "RoofTile",
    ("metal", "steel", "tin", "corrugated_iron", "zinc", "copper", "sheet_metal"): "Metal",
    ("concrete", "cement"): "Concrete",
    "glass": "Glass",
    ("slate", "stone", "shingle"): "Stone",
    ("thatch", "grass", "green"): "Vegetation",
    ("wood", "tar_paper", "felt", "asphalt"): "Asphalt",
    ("plastic", "polycarbonate"): "Plastic",
}
SURFACE_WORDS = {
    ("asphalt", "paved", "tarmac", "bitumen"): "Asphalt",
    ("concrete", "concrete:plates", "concrete:lanes"): "Concrete",
    ("cobblestone", "sett", "paving_stones", "stone", "unhewn_cobblestone", "gravel", "fine_gravel", "pebbles", "compacted", "crushed_stone"): "Stone",
    ("dirt", "earth", "ground", "mud", "unpaved", "soil", "sand"): "Soil",
    ("grass", "grass_paver"): "Grass",
    "wood": "Wood",
    "metal": "Metal",
}
LANDUSE = {("forest", "wood"): "Vegetation", ("grass", "meadow", "recreation_ground"): "Grass", ("farmland", "farmyard", "allotments"): "Soil", ("industrial", "commercial"): "Concrete"}
# Physical constants by category, in the order of PROPERTY_NAMES.
PROPERTY_NAMES = ["emissivity", "absorptivity", "base_temp_k", "conductivity_w", "specific_heat", "density", "thickness_m", "dielectric", "conductivity_s", "rcs", "radar_transparent", "lidar_905", "lidar_1550", "specular", "attenuation_db", "rf_reflection"]
PROPERTIES = """
0.90 0.50 293.15 1.0 880 2000 0.20 3.0 0.01 0.5 0 0.40 0.35 0 8 0.30
0.92 0.65 303.15 1.7 880 2300 0.25 4.5 0.01 1.0 0 0.55 0.50 0 15 0.50
0.93 0.70 305.15 0.72 840 1900 0.23 4.0 0.01 0.9 0 0.42 0.38 0 10 0.30
0.90 0.60 300.15 2.3 840 2600 0.30 6.0 0.01 1.0 0 0.48 0.42 0 12 0.40
0.15 0.40 318.15 50 500 7800 0.003 1e6 3.8e7 2.0 0 0.85 0.80 1 50 0.95
0.92 0.20 298.15 1.0 840 2500 0.006 5.0 1e-12 0.7 0 0.10 0.08 1 3 0.20
0.90 0.55 300.15 0.14 1700 600 0.15 2.5 0.001 0.3 1 0.48 0.42 0 5 0.10
0.92 0.50 305.15 0.20 1500 1200 0.005 2.5 1e-14 0.1 1 0.40 0.35 0 2 0.05
0.91 0.45 302.15 0.70 840 1800 0.03 3.0 0.005 0.7 0 0.52 0.47 0 3 0.15
0.93 0.90 323.15 0.75 920 2300 0.10 4.0 0.01 0.8 0 0.20 0.15 0 8 0.25
0.92 0.75 298.15 1.5 1000 1600 1.0 3.0 0.01 0.5 0 0.30 0.25 0 5 0.15
0.96 0.25 295.15 0.25 3500 800 0.05 20 0.05 0.4 0 0.60 0.28 0 2 0.05
0.97 0.20 293.15 0.20 3800 700 0.10 20 0.05 0.4 0 0.55 0.32 0 3 0.05
0.96 0.06 291.15 0.60 4186 1000 1.0 80 0.01 1.5 0 0.05 0.02 1 20 0.75
0.91 0.65 303.15 1.0 880 2000 0.20 4.0 0.01 0.9 0 0.50 0.45 0 12 0.45
0.90 0.88 313.15 0.84 880 2000 0.05 5.0 0.01 0.9 0 0.38 0.32 0 8 0.30
"""
PROPERTY_ROWS = [[float(x) for x in line.split()] for line in PROPERTIES.strip().splitlines()]
# Assets, their categories by slot, heat output (W) and source temperature (K).
ASSETS = [
    ("WaterTank_Plastic", {0: "Plastic"}, None, None),
    ("WaterTank_Metal", {0: "Metal"}, None, None),
    ("SolarPanel", {0: "Glass", 1: "Metal", 2: "Metal"}, None, None),
    ("AC_Unit", {0: "Metal", 1: "Metal"}, 4000.0, 333.15),
    ("Window_Recessed", {0: "Metal", 1: "Glass"}, None, None),
    ("Antenna", {0: "Metal"}, None, None),
    ("StreetLamp", {0: "Metal", 1: "Glass"}, 150.0, 373.15),
]
REFERENCE_K = 373.15


def _word(text: Column, words: dict) -> Column:
    return F.coalesce(case_of(F.lower(F.trim(text)), words), F.lit("Unknown"))


def parse_building_material(text: Column) -> Column:
    return _word(text, WALL_WORDS)


def parse_roof_material(text: Column) -> Column:
    return _word(text, ROOF_WORDS)


def parse_surface(text: Column) -> Column:
    return _word(text, SURFACE_WORDS)


def infer_wall(subtype: Column, tags: Column) -> Column:
    """By use; offices of over four levels are glass, homes of up to three are plastered."""
    own, levels = F.lower(F.trim(subtype)), F.coalesce(leading_integer(tags["building:levels"]), F.lit(0))
    return (
        F.when(own.isin("commercial", "office", "retail"), F.when(levels > 4, F.lit("Glass")).otherwise("Concrete"))
        .when(own.isin("industrial", "warehouse", "hangar", "factory", "storage_tank"), F.lit("Metal"))
        .when(own.isin("residential", "house", "apartments", "terrace", "detached"), F.when(levels <= 3, F.lit("Plaster")).otherwise("Concrete"))
        .when(own.isin("church", "cathedral", "mosque", "temple", "castle", "monument"), F.lit("Stone"))
        .when(own.isin("garage", "shed", "outbuilding", "cabin", "barn"), F.lit("CementBlock"))
        .when(own == "greenhouse", F.lit("Glass"))
        .otherwise("Concrete")
    )


def infer_roof(subtype: Column) -> Column:
    uses = {
        ("industrial", "warehouse", "hangar", "garage", "shed"): "Metal",
        ("residential", "house", "detached", "terrace"): "RoofTile",
        ("commercial", "office", "apartments"): "Concrete",
        ("church", "temple", "mosque"): "RoofTile",
        "greenhouse": "Glass",
    }
    return case_of(F.lower(F.trim(subtype)), uses, "Concrete")


def _known(category: Column, other: Column) -> Column:
    return F.when(category != "Unknown", category).otherwise(other)


def resolve_materials(nodes: DataFrame) -> DataFrame:
    """Adds wall, roof, ground_floor, surface and dominant category from type, subtype and tags."""
    kind, sub, tags = F.col("node_type"), F.lower("subtype"), F.col("tags")
    named = F.when(has_tag(tags, "building:material"), parse_building_material(tags["building:material"])).otherwise(parse_building_material(tags["building:facade:material"]))
    wall = _known(named, infer_wall(F.col("subtype"), tags))
    roof = _known(parse_roof_material(tags["roof:material"]), infer_roof(F.col("subtype")))
    surface = parse_surface(tags["surface"])
    ground = (
        F.when(kind.isin("RoadSegment", "Junction"), _known(surface, F.lit("Asphalt")))
        .when(kind == "Railway", F.lit("Stone"))
        .when(kind.isin("WaterBody", "Waterway"), F.lit("Water"))
        .when(kind == "VegetationArea", F.lit("Vegetation"))
        .when(kind == "LeisureArea", F.when(sub.isin("pitch", "track"), _known(surface, F.lit("Grass"))).otherwise("Grass"))
        .when(kind == "LanduseZone", case_of(sub, LANDUSE, "Soil"))
        .when(kind == "Amenity", F.when(sub.isin("parking", "fuel"), F.lit("Asphalt")).otherwise("Concrete"))
        .otherwise("Soil")
    )
    house, road = kind == "Building", kind.isin("RoadSegment", "Junction")
    out = nodes.withColumns({"wall": F.when(house, wall).otherwise(ground), "roof": F.when(house, roof).otherwise(ground), "surface": F.when(house, wall).otherwise(ground)})
    floor = F.when(house, F.when(has_tag(tags, "shop"), F.lit("Glass")).otherwise(F.col("wall"))).when(road, F.col("surface")).otherwise("Unknown")
    return out.withColumns({"ground_floor": floor, "dominant": F.when(house, F.col("wall")).otherwise(F.col("surface"))})


def material_props(spark: SparkSession) -> DataFrame:
    rows = [(name, i, *row) for i, (name, row) in enumerate(zip(CATEGORIES, PROPERTY_ROWS))]
    return spark.createDataFrame(rows, "category string, code int, " + ", ".join(f"{n} double" for n in PROPERTY_NAMES))


def with_material_props(df: DataFrame, category_col: str = "category") -> DataFrame:
    """Adds the constants of the category: a broadcast of 16 rows. An unknown name gets those of Unknown."""
    known = F.when(F.col(category_col).isin(CATEGORIES), F.col(category_col)).otherwise("Unknown")
    props = material_props(df.sparkSession).withColumnRenamed("category", "_category")
    return df.withColumn("_key", known).join(F.broadcast(props), F.col("_key") == F.col("_category")).drop("_key", "_category")


def material_thermal(df: DataFrame, ambient_k: Column | float = 293.15) -> DataFrame:
    """Adds inertia, diffusivity and radiance (emitted and reflected, 0 to 1) from the constants. Density is the table's."""
    c = F.col
    ambient = ambient_k if isinstance(ambient_k, Column) else F.lit(ambient_k)
    heat = c("density") * c("specific_heat")
    radiance = c("emissivity") * F.pow(c("base_temp_k") / REFERENCE_K, 4) + (1 - c("emissivity")) * F.pow(ambient / REFERENCE_K, 4)
    return df.withColumns({"inertia": F.sqrt(c("conductivity_w") * heat), "diffusivity": F.when(heat > 0, F.try_divide(c("conductivity_w"), heat)).otherwise(0.0), "radiance": clamp(radiance, 0.0, 1.0)})


def pick_variant(seed: Column, n: Column | int) -> Column:
    """Index of a variant: the seed modulo n, never negative; null if there are none."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.pmod(seed, n))


def palette_lookup(df: DataFrame, palette: DataFrame) -> DataFrame:
    """palette: (category, visual, physical), a row for each of 16 categories at most."""
    return df.join(F.broadcast(palette.filter(F.col("category").isin(CATEGORIES)).dropDuplicates(["category"])), "category", "left")


def upsert_palette(palette: DataFrame, changes: DataFrame) -> DataFrame:
    return palette.join(changes.select("category"), "category", "left_anti").unionByName(changes)


def asset_descriptors(spark: SparkSession) -> DataFrame:
    """asset, slot, category, heat_w, source_k: a row for each slot."""
    rows = [(name, slot, category, heat, kelvin) for name, slots, heat, kelvin in ASSETS for slot, category in slots.items()]
    return spark.createDataFrame(rows, "asset string, slot int, category string, heat_w double, source_k double")


def describe_assets(df: DataFrame, name_col: str) -> DataFrame:
    """Slots of named assets, whatever the case of the name. A broadcast of 12 rows."""
    own = asset_descriptors(df.sparkSession).withColumn("_key", F.lower("asset"))
    return df.withColumn("_key", F.lower(name_col)).join(F.broadcast(own), "_key").drop("_key")


def active_heat_sources(spark: SparkSession) -> DataFrame:
    return asset_descriptors(spark).filter("heat_w is not null").select("asset", "heat_w", "source_k").distinct()


def material_gaps(sections: DataFrame, palette: DataFrame) -> DataFrame:
    """sections: (owner, section, category). Counts sections, and those without visual or (having one) physical material."""
    own = palette_lookup(sections, palette)
    visual = F.col("visual").isNull()
    return own.agg(F.count("*").alias("sections"), F.countDistinct("owner").alias("components"), F.count_if(visual).alias("missing_visual"), F.count_if(~visual & F.col("physical").isNull()).alias("missing_physical"))


def section_problems(sections: DataFrame, palette: DataFrame) -> DataFrame:
    own = palette_lookup(sections, palette)
    what = F.when(F.col("visual").isNull(), F.lit("visual")).when(F.col("physical").isNull(), F.lit("physical"))
    return own.withColumn("missing", what).filter("missing is not null").select("owner", "section", "category", "missing")


def tag_material(tags: Column) -> Column:
    return parse_building_material(get_tag(tags, "building:material"))
