"""Geometry tables: footprints, facades, walls, ribbons, area layers, and checks of meshes.

Meshes are tables: vertices(mesh_id, vertex, x, y, z) and triangles(mesh_id, triangle, section, a, b, c), in centimetres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citygeo.functions.numbers import case_of, nearest
from citygeo.operators.assets import roll
from citygeo.operators.terrain import split_at_triangles, terrain_height

FLOOR_M, DEFAULT_HEIGHT_M, PLINTH_M, BAY_M = 3.2, 9.6, 0.4, 3.0
LEAST_AREA_M2, REPEAT_M, LEAST_EDGE_M, SKIRT_M = 0.5, 0.01, 0.05, 0.5
MOST_MESHES = 5_000  # buildings whose edges are told apart in one part
# Lift (cm) and default width (m) of ribbons, lift of area layers, amenities that are paved.
RIBBONS = {"Waterway": (25.0, 6.0), "Railway": (30.0, 4.0), "RoadSegment": (35.0, None)}
LAYERS = {"LanduseZone": 5.0, "VegetationArea": 10.0, "LeisureArea": 15.0, "Amenity": 20.0, "WaterBody": 25.0}
PAVED = ["parking", "parking_space", "parking_entrance", "bicycle_parking", "motorcycle_parking", "taxi", "fuel", "charging_station", "bus_station", "trolley_bay", "marketplace", "recycling"]


def archetype_height(tagged_m: Column, levels: Column, seed: Column, floor_m: float = FLOOR_M, default_m: float = DEFAULT_HEIGHT_M, jitter_m: float = 0.0) -> Column:
    """A tagged height as it is; else levels or the default, jittered by the seed, and one floor at least."""
    base = F.when(levels > 0, levels * floor_m).otherwise(default_m)
    return F.when(tagged_m > 0, tagged_m).otherwise(F.greatest(base + (roll(seed, F.lit(7)) * 2 - 1) * jitter_m, F.lit(floor_m)))


def signed_area(points: Column) -> Column:
    """Of a ring of (x, y); positive if counter-clockwise."""
    follow = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, follow, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def normalise_footprint(footprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """footprints (node_id, points array<struct<x, y>>) → with points counter-clockwise and no repeated last point, and rejections
    (node_id, reason): under 3 points, or under 0.5 m²."""
    first, last, n = F.col("points")[0], F.element_at("points", -1), F.size("points")
    repeats = (n > 3) & (F.sqrt(F.pow(first["x"] - last["x"], 2) + F.pow(first["y"] - last["y"], 2)) < REPEAT_M)
    once = lambda c: F.explode(F.array(c))  # noqa: E731  made once, not in each expression that reads it
    own = footprints.withColumn("points", once(F.when(n < 1, F.col("points")).when(repeats, F.slice("points", 1, n - 1)).otherwise(F.col("points"))))
    own = own.withColumn("area_m2", once(F.when(F.size("points") >= 3, signed_area(F.col("points"))).otherwise(0.0)))
    reason = F.when(F.size("points") < 3, F.lit("footprint has under 3 points")).when(F.abs("area_m2") < LEAST_AREA_M2, F.lit("footprint is a sliver"))
    own = own.withColumn("reason", reason)
    good = own.filter("reason is null").drop("reason").withColumn("points", F.when(F.col("area_m2") < 0, F.reverse("points")).otherwise(F.col("points")))
    return good.withColumn("area_m2", F.abs("area_m2")), own.filter("reason is not null").select("node_id", "reason")


def bay_count(length_m: Column, bay_m: float = BAY_M) -> Column:
    return F.greatest(nearest(length_m / bay_m), F.lit(1)).cast("int") if bay_m > 0 else F.lit(1)


def facade_bays(footprints: DataFrame, bay_m: float = BAY_M) -> DataFrame:
    """node_id, edge, bay, bays, length_m, ax, ay, bx, by, nx, ny (and height_m, if footprints have it): edges of 5 cm or more cut into even
    bays, with outward normals."""
    kept = ["node_id", "height_m"] if "height_m" in footprints.columns else ["node_id"]
    follow = F.concat(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 1, 1))
    edges = footprints.select(*kept, F.posexplode(F.zip_with("points", follow, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("edge", "e"))
    dx, dy = F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")
    edges = edges.withColumns({"dx": dx, "dy": dy, "length_m": F.sqrt(dx * dx + dy * dy)}).filter(F.col("length_m") >= LEAST_EDGE_M)
    bays = edges.withColumn("bays", bay_count(F.col("length_m"), bay_m)).withColumn("bay", F.explode(F.sequence(F.lit(0), F.col("bays") - 1)))
    at = lambda k, t: F.col(f"e.a.{k}") + F.col(f"d{k}") * t
    t0, t1 = F.col("bay") / F.col("bays"), (F.col("bay") + 1) / F.col("bays")
    return bays.select(*kept, "edge", "bay", "bays", "length_m", at("x", t0).alias("ax"), at("y", t0).alias("ay"), at("x", t1).alias("bx"), at("y", t1).alias("by"), (F.col("dy") / F.col("length_m")).alias("nx"), (-F.col("dx") / F.col("length_m")).alias("ny"))


def wall_quads(bays: DataFrame, heights: DataFrame | None = None, floor_m: float = FLOOR_M, plinth_m: float = PLINTH_M) -> DataFrame:
    """node_id, edge, bay, section (GroundFloor or Wall), corners (cm), normal, u and v ranges (m). heights: (node_id, height_m), if bays
    have none of their own."""
    own = (bays if heights is None else bays.join(heights, "node_id")).withColumn("_h", F.greatest(F.col("height_m"), F.lit(0.5)) * 100)
    top = F.least(F.lit((plinth_m + max(2.0, floor_m)) * 100), F.col("_h"))
    band = lambda name, low, high: F.struct(F.lit(name).alias("section"), low.alias("low"), high.alias("high"))
    zero = F.lit(0.0)
    bands = F.when(top < F.col("_h") - 1, F.array(band("GroundFloor", zero, top), band("Wall", top, F.col("_h")))).otherwise(F.array(band("GroundFloor", zero, F.col("_h"))))
    rows = own.withColumn("_b", F.explode(bands))
    corner = lambda p, z: F.struct((F.col(f"{p}x") * 100).alias("x"), (F.col(f"{p}y") * 100).alias("y"), F.col(f"_b.{z}").alias("z"))
    u0, u1 = F.col("length_m") * F.col("bay") / F.col("bays"), F.col("length_m") * (F.col("bay") + 1) / F.col("bays")
    return rows.select("node_id", "edge", "bay", F.col("_b.section").alias("section"), F.array(corner("a", "low"), corner("b", "low"), corner("b", "high"), corner("a", "high")).alias("corners"), F.array("nx", "ny", F.lit(0.0)).alias("normal"), u0.alias("u0"), u1.alias("u1"), (F.col("_b.low") / 100).alias("v0"), (F.col("_b.high") / 100).alias("v1"))


def seat_buildings(heights: DataFrame, ranges: DataFrame, skirt_m: float = SKIRT_M) -> DataFrame:
    """heights (node_id, height_m) and ground ranges (node_id, min_cm, max_cm) → base_cm half a metre into the lowest ground, and
    the height from there up to the building's own above the highest."""
    own = heights.join(ranges, "node_id", "left").withColumns({"min_cm": F.coalesce("min_cm", F.lit(0.0)), "max_cm": F.coalesce("max_cm", F.lit(0.0))})
    base = F.col("min_cm") - max(skirt_m, 0.0) * 100
    return own.select("node_id", base.alias("base_cm"), (F.col("height_m") + (F.col("max_cm") - base) / 100).alias("height_m"))


def ribbon_half_width(node_type: Column, subtype: Column, width_m: Column) -> Column:
    default = case_of(node_type, {k: w for k, (_, w) in RIBBONS.items() if w})
    return F.when(width_m > 0.5, width_m).otherwise(F.coalesce(default, F.when(subtype.isin("footway", "path"), 2.0).otherwise(6.0))) / 2


def linear_ribbons(lines: DataFrame, frame: DataFrame, grid: DataFrame) -> DataFrame:
    """lines (line_id, region_key, node_type, subtype, width_m, points) → line_id, n, left and right edge (m), heights (cm, lifted), length_m so far.

    Lines are split where they cross the terrain's triangles; the direction at a point is mitred from both neighbours.
    """
    kinds = lines.filter(F.col("node_type").isin(list(RIBBONS)) & (F.size("points") > 1)).withColumn("closed", F.lit(False))
    order = Window.partitionBy("line_id").orderBy("pos")
    own = split_at_triangles(kinds, frame).withColumns({f"{f.__name__}_{a}": f(f"{a}_m").over(order) for f in (F.lag, F.lead) for a in "xy"})

    def unit(x: Column, y: Column) -> tuple[Column, Column]:
        length = F.sqrt(x * x + y * y)
        return tuple(F.when(length > 1e-8, F.try_divide(v, length)).otherwise(0.0) for v in (x, y))

    back, ahead = ((F.coalesce(d * (F.col(f"{n}_x") - F.col("x_m")), F.lit(0.0)), F.coalesce(d * (F.col(f"{n}_y") - F.col("y_m")), F.lit(0.0))) for n, d in (("lag", -1), ("lead", 1)))
    (bx, by), (fx, fy) = unit(*back), unit(*ahead)
    own = own.withColumns({"_sx": bx + fx, "_sy": by + fy, "_d": F.sqrt(back[0] * back[0] + back[1] * back[1]), "n": F.row_number().over(order) - 1})
    dx, dy = unit(F.col("_sx"), F.col("_sy"))
    own = own.withColumns({"_dx": dx, "_dy": dy, "length_m": F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    own = own.join(kinds.select("line_id", "node_type", ribbon_half_width(F.col("node_type"), F.col("subtype"), F.col("width_m")).alias("_half")), "line_id")
    side = lambda s: F.struct(F.lit("left" if s > 0 else "right").alias("side"), (F.col("x_m") - s * F.col("_dy") * F.col("_half")).alias("x_m"), (F.col("y_m") + s * F.col("_dx") * F.col("_half")).alias("y_m"))
    both = own.select("line_id", "region_key", "node_type", "n", "length_m", F.explode(F.array(side(1), side(-1))).alias("_e")).select("line_id", "region_key", "node_type", "n", "length_m", "_e.*")
    high = terrain_height(both, frame, grid)
    return high.select("line_id", "n", "side", "x_m", "y_m", (F.col("height_cm") + case_of(F.col("node_type"), {k: lift for k, (lift, _) in RIBBONS.items()})).alias("z_cm"), "length_m")


def area_layers(nodes: DataFrame) -> DataFrame:
    """node_id, layer, lift_cm (and osm_id, if nodes have it) of areas that are drawn: amenities only if they are paved."""
    kind = F.col("node_type")
    shown = F.col("is_area") & kind.isin(list(LAYERS)) & ((kind != "Amenity") | F.col("subtype").isin(PAVED))
    source = ["osm_id"] if "osm_id" in nodes.columns else []
    return nodes.filter(shown).select("node_id", kind.alias("layer"), case_of(kind, LAYERS).alias("lift_cm"), *source)


def _corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    out = triangles
    for k in "abc":
        out = out.join(vertices.select("mesh_id", F.col("vertex").alias(k), F.struct("x", "y", "z").alias(f"p{k}")), ["mesh_id", k])
    return _with_normals(out)


def _with_normals(faces: DataFrame) -> DataFrame:
    e = lambda p, q, k: F.col(f"{q}.{k}") - F.col(f"{p}.{k}")
    u, v = [e("pa", "pb", k) for k in "xyz"], [e("pa", "pc", k) for k in "xyz"]
    return faces.withColumns({"_nx": u[1] * v[2] - u[2] * v[1], "_ny": u[2] * v[0] - u[0] * v[2], "_nz": u[0] * v[1] - u[1] * v[0]})


def mesh_area(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, area_m2."""
    n = F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz"))
    return _corners(vertices, triangles).groupBy("mesh_id").agg((F.sum(n) / 2 / 10_000).alias("area_m2"))


def mesh_section(triangles: DataFrame, section: str) -> DataFrame:
    return triangles.filter(F.col("section") == section)


def mesh_bounds(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("mesh_id").agg(*[f(k).alias(f"{n}_{k}") for k in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


def _welded(p: Column) -> Column:
    return F.struct(*[nearest(p[k] * 10).cast("long").alias(k) for k in "xyz"])


def mesh_closure(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, edges, open_edges (in one triangle), crowded_edges (in over two), after welding vertices to 0.1 cm."""
    place = _welded(F.struct("x", "y", "z"))
    out = triangles
    for k in "abc":
        out = out.join(vertices.select("mesh_id", F.col("vertex").alias(k), place.alias(f"p{k}")), ["mesh_id", k])
    side = lambda p, q: F.struct(F.least(F.col(p), F.col(q)).alias("low"), F.greatest(F.col(p), F.col(q)).alias("high"))
    edges = out.select("mesh_id", F.explode(F.array(side("pa", "pb"), side("pb", "pc"), side("pc", "pa"))).alias("e")).filter("e.low <> e.high")
    return edges.groupBy("mesh_id", "e").count().groupBy("mesh_id").agg(F.count("*").alias("edges"), F.count_if(F.col("count") == 1).alias("open_edges"), F.count_if(F.col("count") > 2).alias("crowded_edges"))


def quad_faces(quads: DataFrame) -> DataFrame:
    """mesh_id, pa, pb, pc: the triangles of quad_mesh with their corners (cm), for those who need no vertices: none is numbered or looked up."""
    p = lambda k: F.col("corners")[k]
    two = F.array(*[F.struct(p(a).alias("pa"), p(b).alias("pb"), p(c).alias("pc")) for a, b, c in ((0, 2, 1), (0, 3, 2))])
    return quads.select(F.col("node_id").alias("mesh_id"), F.explode(two).alias("t")).select("mesh_id", "t.*")


def face_checks(faces: DataFrame) -> DataFrame:
    """faces (mesh_id, pa, pb, pc) → mesh_id, edges, open_edges, crowded_edges, area_m2: mesh_closure and mesh_area in one pass. The area of
    a triangle goes with the first of its sides. Both groupings are within a mesh, so where faces lie by mesh_id nothing is moved."""
    own = _with_normals(faces).withColumns({f"w{k}": _welded(F.col(f"p{k}")) for k in "abc"})
    half = F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz")) / 2
    side = lambda p, q, area: F.struct(F.least(F.col(p), F.col(q)).alias("low"), F.greatest(F.col(p), F.col(q)).alias("high"), area.alias("area"))
    zero = F.lit(0.0)
    sides = own.select("mesh_id", F.explode(F.array(side("wa", "wb", half), side("wb", "wc", zero), side("wc", "wa", zero))).alias("e")).select("mesh_id", "e.*")
    met = sides.groupBy("mesh_id", "low", "high").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    long = F.col("low") != F.col("high")
    counts = [F.count_if(long).alias("edges"), F.count_if(long & (F.col("n") == 1)).alias("open_edges"), F.count_if(long & (F.col("n") > 2)).alias("crowded_edges")]
    return met.groupBy("mesh_id").agg(*counts, (F.sum("area") / 10_000).alias("area_m2"))


def mesh_normals(vertices: DataFrame, triangles: DataFrame, level: float = 0.7) -> DataFrame:
    """mesh_id, up, down: triangles that are near horizontal, by the sign of their normal."""
    n = F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz"))
    tilt = F.try_divide(F.col("_nz"), n)
    return _corners(vertices, triangles).groupBy("mesh_id").agg(F.count_if(tilt > level).alias("up"), F.count_if(tilt < -level).alias("down"))


def quad_mesh(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of wall quads, one mesh for each node."""
    first = (F.row_number().over(Window.partitionBy("node_id").orderBy("edge", "bay", "section")) - 1) * 4
    own = quads.withColumn("_first", first.cast("long"))
    vertices = own.select(F.col("node_id").alias("mesh_id"), "_first", F.posexplode("corners").alias("k", "p")).select("mesh_id", (F.col("_first") + F.col("k")).alias("vertex"), "p.x", "p.y", "p.z")
    two = F.array(*[F.struct((F.col("_first") + a).alias("a"), (F.col("_first") + b).alias("b"), (F.col("_first") + c).alias("c")) for a, b, c in ((0, 2, 1), (0, 3, 2))])
    triangles = own.select(F.col("node_id").alias("mesh_id"), "section", F.posexplode(two).alias("k", "t"), (F.col("_first") / 2).cast("long").alias("t0")).select("mesh_id", (F.col("t0") + F.col("k")).alias("triangle"), "section", "t.a", "t.b", "t.c")
    return vertices, triangles


def build_tally(made: DataFrame, skipped: DataFrame) -> DataFrame:
    """kind, reason, count: made (kind) and skipped (kind, reason)."""
    return made.select("kind", F.lit("").alias("reason")).unionByName(skipped.select("kind", "reason")).groupBy("kind", "reason").count()
