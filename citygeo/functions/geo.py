"""Coordinates: ellipsoid, local frames, regions, geoid, pixels, and the geometry of one ring or line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citygeo.functions.numbers import clamp

# WGS84, metres and kilometres per degree, region limits.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
M_PER_DEGREE, KM_PER_DEGREE = 111320.0, 111.32
MIN_KM2, MAX_KM2, MAX_LAT, CLIP_MARGIN = 0.05, 25.0, 85.0, 0.001
# Geoid separation in metres, rows from latitude 90 down in steps of 10, columns from longitude -180 in steps of 10.
GEOID = """
13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13
29 29 27 24 20 15 11 8 5 3 1 -1 -2 -4 -6 -9 -10 -10 -10 -10 -8 -6 -4 -2 0 2 5 8 11 14 17 19 22 24 26 28
22 16 6 -5 -18 -28 -33 -34 -32 -28 -22 -16 -11 -7 -4 -2 0 2 3 1 -3 -8 -12 -15 -17 -19 -20 -21 -19 -15 -8 0 9 16 21 23
2 -1 -8 -17 -25 -32 -36 -37 -34 -28 -21 -14 -8 -3 0 2 3 3 2 0 -4 -9 -14 -19 -22 -24 -25 -24 -21 -15 -6 4 14 22 27 28
-10 -13 -17 -22 -27 -30 -31 -30 -27 -22 -16 -10 -5 0 4 6 7 6 5 2 -3 -9 -15 -20 -24 -27 -29 -29 -28 -23 -14 -3 8 18 25 27
-8 -11 -14 -17 -19 -19 -19 -17 -14 -10 -7 -3 1 5 8 10 11 10 9 6 1 -5 -12 -18 -23 -27 -30 -31 -31 -28 -21 -11 0 11 19 23
7 5 2 -2 -5 -6 -6 -5 -3 0 3 6 9 11 13 14 14 13 12 9 4 -2 -9 -16 -22 -27 -30 -32 -32 -30 -25 -17 -7 3 12 18
22 20 16 11 7 3 0 -2 -3 -2 0 3 6 9 12 14 15 15 14 12 7 1 -5 -12 -18 -23 -27 -29 -30 -29 -25 -18 -10 -1 8 15
22 21 17 13 9 6 4 3 3 4 6 8 11 13 15 16 17 16 15 13 9 3 -3 -10 -17 -22 -26 -29 -30 -29 -27 -21 -13 -4 4 13
13 12 9 6 3 1 0 0 1 3 5 7 9 11 13 14 15 15 15 13 9 3 -3 -10 -16 -21 -26 -29 -31 -31 -29 -24 -17 -8 0 7
-10 -10 -11 -13 -15 -16 -15 -14 -12 -10 -7 -4 -2 0 2 3 5 5 6 5 2 -2 -8 -14 -20 -25 -29 -32 -34 -34 -32 -28 -22 -14 -6 -1
-30 -30 -30 -31 -31 -31 -30 -28 -25 -22 -18 -14 -10 -7 -5 -3 -2 -2 -1 -2 -5 -9 -15 -20 -26 -31 -35 -38 -40 -40 -39 -36 -31 -25 -18 -12
-46 -46 -46 -46 -45 -43 -40 -37 -33 -29 -25 -21 -17 -14 -11 -9 -8 -8 -8 -9 -12 -16 -22 -28 -34 -40 -45 -48 -50 -50 -49 -47 -44 -40 -35 -30
-54 -54 -54 -53 -52 -49 -46 -42 -37 -33 -28 -23 -19 -16 -14 -12 -11 -11 -12 -14 -17 -21 -27 -33 -40 -46 -52 -57 -60 -61 -61 -60 -57 -53 -48 -43
-61 -61 -61 -60 -58 -55 -51 -46 -40 -34 -28 -23 -18 -14 -12 -11 -11 -12 -14 -17 -21 -26 -32 -39 -46 -53 -60 -65 -68 -70 -70 -69 -67 -63 -59 -55
-53 -52 -50 -48 -45 -41 -36 -30 -23 -17 -11 -6 -2 0 0 -1 -3 -6 -10 -14 -19 -25 -31 -37 -44 -51 -57 -62 -66 -68 -68 -67 -65 -62 -58 -55
-24 -22 -19 -16 -12 -8 -3 1 5 8 10 12 13 12 10 7 3 -1 -5 -9 -14 -19 -24 -30 -36 -41 -46 -50 -53 -55 -55 -54 -52 -49 -46 -43
27 30 33 35 37 38 37 35 32 28 24 19 14 9 5 1 -3 -7 -11 -14 -18 -21 -25 -28 -31 -33 -36 -37 -37 -36 -34 -31 -28 -24 -20 -16
13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13 13
"""
GEOID_ROWS = [[int(x) for x in line.split()] for line in GEOID.strip().splitlines()]


def km_per_degree_lon(lat: Column) -> Column:
    return KM_PER_DEGREE * F.cos(F.radians(lat))


def to_ecef(lat: Column, lon: Column, height: Column) -> Column:
    """struct(x, y, z) in metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = SEMI_MAJOR / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return F.struct(((n + height) * F.cos(phi) * F.cos(lam)).alias("x"), ((n + height) * F.cos(phi) * F.sin(lam)).alias("y"), ((n * (1 - E2) + height) * F.sin(phi)).alias("z"))


def to_enu_cm(lat: Column, lon: Column, height: Column, lat0: Column, lon0: Column, height0: Column, kind: str = "float") -> Column:
    """struct(east, north, up) in centimetres about an origin, as floats, or as doubles: a float of a place 10 km away is told to the
    millimetre, one of a place 1,000 km away to 8 cm."""
    p, o = to_ecef(lat, lon, height), to_ecef(lat0, lon0, height0)
    dx, dy, dz = p["x"] - o["x"], p["y"] - o["y"], p["z"] - o["z"]
    s, c, sl, cl = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    east, north = -sl * dx + cl * dy, -s * cl * dx - s * sl * dy + c * dz
    up = c * cl * dx + c * sl * dy + s * dz
    return F.struct(*[(v * 100).cast(kind).alias(n) for n, v in (("east", east), ("north", north), ("up", up))])


def from_enu_cm(enu: Column, lat0: Column, lon0: Column, height0: Column, rounds: int = 5) -> Column:
    """struct(lat, lon, height) of a point in the local frame; the latitude is refined a fixed number of times."""
    e, n, u = (enu[k].cast("double") / 100 for k in ("east", "north", "up"))
    s, c, sl, cl = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    o = to_ecef(lat0, lon0, height0)
    x = o["x"] - sl * e - s * cl * n + c * cl * u
    y = o["y"] + cl * e - s * sl * n + c * sl * u
    z = o["z"] + c * n + s * u
    p = F.sqrt(x * x + y * y)
    curve = lambda phi: SEMI_MAJOR / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))

    def refine(phi: Column, _: Column) -> Column:
        height = p / F.cos(phi) - curve(phi)
        return F.atan2(z, p * (1 - E2 * curve(phi) / (curve(phi) + height)))

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(z, p * (1 - E2)), refine)
    return F.struct(F.degrees(phi).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), (p / F.cos(phi) - curve(phi)).alias("height"))


def to_local_m(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """struct(x_north, y_east) in metres: flat, north on x."""
    return F.struct(((lat - lat0) * M_PER_DEGREE).alias("x_north"), ((lon - lon0) * M_PER_DEGREE * F.cos(F.radians(lat0))).alias("y_east"))


def from_local_m(x: Column, y: Column, lat0: Column, lon0: Column) -> Column:
    scale = M_PER_DEGREE * F.cos(F.radians(lat0))
    return F.struct((lat0 + x / M_PER_DEGREE).alias("lat"), (lon0 + F.when(scale != 0, y / scale).otherwise(0.0)).alias("lon"))


def geoid_separation(lat: Column, lon: Column) -> Column:
    """Metres between ellipsoid and geoid: bilinear on the grid, longitude wrapped, latitudes south of -80 clamped."""
    grid = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in GEOID_ROWS])
    row = (90.0 - clamp(lat, -80.0, 90.0)) / 10
    col = F.pmod(lon + 180.0, F.lit(360.0)) / 10
    r0 = clamp(F.floor(row).cast("int"), 0, 17)
    c0 = F.pmod(F.floor(col).cast("int"), F.lit(36))
    at = lambda r, c: F.element_at(F.element_at(grid, r + 1), F.pmod(c, F.lit(36)) + 1)
    tr, tc = row - F.floor(row), col - F.floor(col)
    mix = lambda a, b, t: a + (b - a) * t
    return mix(mix(at(r0, c0), at(r0, c0 + 1), tc), mix(at(r0 + 1, c0), at(r0 + 1, c0 + 1), tc), tr)


def pixel_to_latlon(col: Column, row: Column, gt: Column) -> Column:
    """Centre of a pixel; gt is (lon0, lon step, 0, lat0, 0, lat step)."""
    return F.struct((gt[3] + (row + 0.5) * gt[5]).alias("lat"), (gt[0] + (col + 0.5) * gt[1]).alias("lon"))


def latlon_to_pixel(lat: Column, lon: Column, gt: Column) -> Column:
    """struct(col, row), fractional; 0 where a step is about 0."""
    over = lambda d, step: F.when(F.abs(step) < 1e-12, F.lit(0.0)).otherwise(F.try_divide(d, step) - 0.5)
    return F.struct(over(lon - gt[0], gt[1]).alias("col"), over(lat - gt[3], gt[5]).alias("row"))


def extract_bbox(text: Column) -> Column:
    """struct(west, south, east, north) from ``bbox=W,S,E,N`` in a text or URL, else from its first four decimals; else null."""
    number = r"-?[0-9]+(?:\.[0-9]+)?"
    named = F.regexp_extract_all(F.regexp_replace(F.regexp_extract(text, rf"(?i)bbox=({number}(?:(?:,|%2C){number}){{3}})", 1), "(?i)%2C", ","), F.lit(f"({number})"), 1)
    loose = F.regexp_extract_all(text, F.lit(r"(-?[0-9]+\.[0-9]+)"), 1)
    parts = F.when(F.size(named) == 4, named).when(F.size(loose) >= 4, F.slice(loose, 1, 4))
    return F.when(parts.isNotNull(), F.struct(*[parts[i].cast("double").alias(n) for i, n in enumerate(("west", "south", "east", "north"))]))


def _edges(points: Column, closed: bool) -> Column:
    """array<struct(a, b)> of neighbouring points; a closed ring joins its last to its first."""
    follow = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1)) if closed else F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    start = points if closed else F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.when(F.size(points) > 1, F.zip_with(start, follow, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<lat:double,lon:double>,b:struct<lat:double,lon:double>>>"))


def ring_area_m2(points: Column, mid_lat: Column) -> Column:
    """Shoelace area of a ring of (lat, lon), in metres scaled at mid_lat, about its first point."""
    k = M_PER_DEGREE * M_PER_DEGREE * F.cos(F.radians(mid_lat))
    o = points[0]
    cross = lambda e: (e["a"]["lat"] - o["lat"]) * (e["b"]["lon"] - o["lon"]) - (e["b"]["lat"] - o["lat"]) * (e["a"]["lon"] - o["lon"])
    twice = F.aggregate(_edges(points, True), F.lit(0.0), lambda acc, e: acc + cross(e))
    return F.when(F.size(points) >= 3, F.abs(twice) * 0.5 * k).otherwise(0.0)


def distance_m(a: Column, b: Column, mid_lat: Column) -> Column:
    x = (a["lat"] - b["lat"]) * M_PER_DEGREE
    y = (a["lon"] - b["lon"]) * M_PER_DEGREE * F.cos(F.radians(mid_lat))
    return F.sqrt(x * x + y * y)


def ring_length_m(points: Column, mid_lat: Column, closed: bool) -> Column:
    return F.aggregate(_edges(points, closed), F.lit(0.0), lambda acc, e: acc + distance_m(e["a"], e["b"], mid_lat))


def vertex_mean(points: Column) -> Column:
    n = F.size(points)
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[k])
    return F.when(n > 0, F.struct((total("lat") / n).alias("lat"), (total("lon") / n).alias("lon")))


def shape_metrics(points: Column, is_area: Column, mid_lat: Column) -> Column:
    """struct(area_m2, length_m, centroid) of a ring or a line in one pass: as ring_area_m2, ring_length_m, and ring_centroid or vertex_mean."""
    n = F.size(points)
    later = F.slice(points, 2, F.greatest(n - 1, F.lit(0)))
    k = M_PER_DEGREE * M_PER_DEGREE * F.cos(F.radians(mid_lat))
    none = F.lit(0.0)
    zero = lambda o: F.struct(o["lat"].alias("lat"), o["lon"].alias("lon"), none.alias("a"), none.alias("x"), none.alias("y"), none.alias("length"), o["lat"].alias("lats"), o["lon"].alias("lons"))

    def step(o: Column, acc: Column, p: Column) -> Column:
        ax, ay, bx, by = acc["lat"] - o["lat"], acc["lon"] - o["lon"], p["lat"] - o["lat"], p["lon"] - o["lon"]
        cross = ax * by - bx * ay
        sums = [(acc["a"] + cross).alias("a"), (acc["x"] + (ax + bx) * cross).alias("x"), (acc["y"] + (ay + by) * cross).alias("y"), (acc["length"] + distance_m(acc, p, mid_lat)).alias("length")]
        return F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), *sums, (acc["lats"] + p["lat"]).alias("lats"), (acc["lons"] + p["lon"]).alias("lons"))

    def line_step(acc: Column, p: Column) -> Column:
        return F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), none.alias("a"), none.alias("x"), none.alias("y"), (acc["length"] + distance_m(acc, p, mid_lat)).alias("length"), (acc["lats"] + p["lat"]).alias("lats"), (acc["lons"] + p["lon"]).alias("lons"))

    def ring(o: Column, s: Column) -> Column:
        middle = F.struct((o["lat"] + F.try_divide(s["x"], 3 * s["a"])).alias("lat"), (o["lon"] + F.try_divide(s["y"], 3 * s["a"])).alias("lon"))
        area = F.when(n >= 3, F.abs(s["a"]) * 0.5 * k).otherwise(0.0)
        return F.struct(area.alias("area_m2"), s["length"].alias("length_m"), F.when((n >= 3) & (F.abs(s["a"]) > 1e-18), middle).otherwise(vertex_mean(points)).alias("centroid"))

    def line(s: Column) -> Column:
        return F.struct(F.lit(0.0).alias("area_m2"), s["length"].alias("length_m"), F.when(n > 0, F.struct((s["lats"] / n).alias("lat"), (s["lons"] / n).alias("lon"))).alias("centroid"))

    def own(o: Column) -> Column:
        area = F.aggregate(F.concat(later, F.slice(points, 1, 1)), zero(o), lambda acc, p: step(o, acc, p), lambda s: ring(o, s))
        return F.when(is_area, area).otherwise(F.aggregate(later, zero(o), line_step, line))

    # the first point is taken out of the array once, not at each step
    first = F.array(F.get(points, F.lit(0)))
    return F.get(F.transform(first, own), F.lit(0))


def ring_centroid(points: Column) -> Column:
    """Area-weighted centroid of a ring, about its first point; vertex mean where the area is 0."""
    o = points[0]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lat"] - o["lat"], e["a"]["lon"] - o["lon"], e["b"]["lat"] - o["lat"], e["b"]["lon"] - o["lon"]
        cross = ax * by - bx * ay
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (ax + bx) * cross).alias("x"), (acc["y"] + (ay + by) * cross).alias("y"))

    s = F.aggregate(_edges(points, True), zero, step)
    found = F.struct((o["lat"] + F.try_divide(s["x"], 3 * s["a"])).alias("lat"), (o["lon"] + F.try_divide(s["y"], 3 * s["a"])).alias("lon"))
    return F.when((F.size(points) >= 3) & (F.abs(s["a"]) > 1e-18), found).otherwise(vertex_mean(points))


def point_in_ring(lat: Column, lon: Column, points: Column) -> Column:
    """Even-odd test with half-open edges."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        where = F.try_divide((a["lat"] - b["lat"]) * (lon - b["lon"]), a["lon"] - b["lon"]) + b["lat"]
        return ((a["lon"] > lon) != (b["lon"] > lon)) & F.coalesce(lat < where, F.lit(False))

    return F.when(F.size(points) >= 3, F.aggregate(_edges(points, True), F.lit(False), lambda acc, e: acc != crosses(e))).otherwise(False)


def point_segment_m(lat: Column, lon: Column, a: Column, b: Column, mid_lat: Column) -> Column:
    """Metres from a point to a segment."""
    k = M_PER_DEGREE * F.cos(F.radians(mid_lat))
    px, py = (lat - a["lat"]) * M_PER_DEGREE, (lon - a["lon"]) * k
    bx, by = (b["lat"] - a["lat"]) * M_PER_DEGREE, (b["lon"] - a["lon"]) * k
    t = F.coalesce(clamp(F.try_divide(px * bx + py * by, bx * bx + by * by), 0.0, 1.0), F.lit(0.0))
    return F.sqrt((px - bx * t) * (px - bx * t) + (py - by * t) * (py - by * t))
