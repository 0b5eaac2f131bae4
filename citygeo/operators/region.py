"""Regions: checked construction, extents, containment and box algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citygeo.functions.geo import KM_PER_DEGREE, MAX_KM2, MAX_LAT, MIN_KM2, km_per_degree_lon
from citygeo.functions.numbers import finite
from citygeo.operators.spatial import COARSE_DEG, FINE_DEG, box_cells, is_wide, place_cells, sized_cells
from citygeo.operators.spatial import cell as cell_of

BOX = ["min_lat", "min_lon", "max_lat", "max_lon"]


def _first(checks: list[tuple[Column, str]]) -> Column:
    """Code of the first check that is true, null if none is."""
    return reduce(lambda acc, c: F.coalesce(acc, F.when(c[0], F.lit(c[1]))), checks, F.lit(None).cast("string"))


def width_km() -> Column:
    return (F.col("max_lon") - F.col("min_lon")) * km_per_degree_lon((F.col("min_lat") + F.col("max_lat")) / 2)


def height_km() -> Column:
    return (F.col("max_lat") - F.col("min_lat")) * KM_PER_DEGREE


def _box_checks(limits: bool) -> list[tuple[Column, str]]:
    a, b, c, d = (F.col(k) for k in BOX)
    checks = [
        (~(finite(a) & finite(b) & finite(c) & finite(d)), "region.nonfinite"),
        ((a < -90) | (c > 90), "region.latitude"),
        ((b < -180) | (d > 180), "region.longitude"),
        ((c <= a) | (d <= b), "region.degenerate"),
    ]
    if limits:
        area = width_km() * height_km()
        checks += [(F.abs((a + c) / 2) > MAX_LAT, "region.polar"), (area > MAX_KM2, "region.toolarge"), (area < MIN_KM2, "region.toosmall")]
    return checks


def regions_from_bbox(df: DataFrame, limits: bool = True) -> DataFrame:
    """Adds error: the first reason that the box is no region, else null."""
    return df.withColumn("error", _first(_box_checks(limits)))


def regions_from_center(df: DataFrame) -> DataFrame:
    """lat, lon, area_km2 → adds the box and error."""
    lat, lon, area = F.col("lat"), F.col("lon"), F.col("area_km2")
    half = F.sqrt(F.greatest(area, F.lit(0.0))) / 2
    half_lat, half_lon = half / KM_PER_DEGREE, F.try_divide(half, km_per_degree_lon(lat))
    box = {"min_lat": lat - half_lat, "min_lon": lon - half_lon, "max_lat": lat + half_lat, "max_lon": lon + half_lon}
    own = [
        (~(finite(lat) & finite(lon) & finite(area)), "region.nonfinite"),
        ((F.abs(lat) > 90) | (F.abs(lon) > 180), "region.center"),
        ((area > MAX_KM2) | (area < MIN_KM2), "region.area"),
        (F.abs(lat) > MAX_LAT, "region.polar"),
        ((lon - half_lon < -180) | (lon + half_lon > 180), "region.antimeridian"),
    ]
    out = df.withColumns(box).withColumn("error", _first(own + _box_checks(False)))
    return out.withColumns({k: F.when(F.col("error").isNull(), F.col(k)) for k in BOX})


def observed_bounds(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bounds of lat and lon, with the error of a box that has no size limits."""
    agg = [F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon")]
    return regions_from_bbox(df.groupBy(*(by or [])).agg(*agg), limits=False)


def region_extent(regions: DataFrame) -> DataFrame:
    return regions.withColumns({"width_km": width_km(), "height_km": height_km(), "area_km2": width_km() * height_km()})


def _inside(lat: str, lon: str) -> Column:
    return F.col(lat).between(F.col("min_lat"), F.col("max_lat")) & F.col(lon).between(F.col("min_lon"), F.col("max_lon"))


def points_in_region(points: DataFrame, regions: DataFrame, cell: float = FINE_DEG) -> DataFrame:
    """Points (lat, lon) with every region that holds them, borders included: an equi-join on cells of ``cell`` degrees, or on
    coarse cells for wide regions. Spark's size check decides on broadcasting."""
    cells = sized_cells(regions, *[F.col(k) for k in BOX], cell)
    own = points.withColumn("_at", F.explode(place_cells(F.col("lat"), F.col("lon"), cell)))
    own = own.withColumns({"_size": F.col("_at.size"), "_row": F.col("_at.row"), "_col": F.col("_at.col")}).drop("_at")
    return own.join(cells, ["_size", "_row", "_col"]).filter(_inside("lat", "lon")).drop("_size", "_row", "_col")


def box_relations(a: DataFrame, b: DataFrame, cell: float = FINE_DEG) -> DataFrame:
    """Pairs of boxes (keys a_key and b_key) that touch: intersects (strict), contains (a holds b), covered (share of b in a).

    Boxes meet on cells of ``cell`` degrees if both are small, and on coarse cells if a is wide (way 1) or only b is (way 2). A pair
    is counted in the one cell that holds the lower corner of what the two share.
    """

    def celled(df: DataFrame, p: str, coarse: Column) -> DataFrame:
        own = df.select(F.col("region_key").alias(f"{p}_key"), *[F.col(k).alias(f"{p}_{k}") for k in BOX])
        box = [F.col(f"{p}_{k}") for k in BOX]
        own = own.withColumn("_wide", is_wide(*box, cell)).withColumn("_way", F.explode(coarse)).drop("_wide")
        size = F.when(F.col("_way") == 0, cell).otherwise(COARSE_DEG)
        return box_cells(own, *box, size, size)

    ways = lambda *n: F.array(*[F.lit(k) for k in n])
    of_a = celled(a, "a", F.when(F.col("_wide"), ways(1)).otherwise(ways(0, 2)))
    of_b = celled(b, "b", F.when(F.col("_wide"), ways(1, 2)).otherwise(ways(0, 1)))
    own_size = F.when(F.col("_way") == 0, cell).otherwise(COARSE_DEG)
    met = of_a.join(of_b, ["_way", "_row", "_col"])
    met = met.filter((F.col("a_min_lat") <= F.col("b_max_lat")) & (F.col("b_min_lat") <= F.col("a_max_lat")) & (F.col("a_min_lon") <= F.col("b_max_lon")) & (F.col("b_min_lon") <= F.col("a_max_lon")))
    pairs = met.filter((F.col("_row") == cell_of(F.greatest("a_min_lat", "b_min_lat"), own_size)) & (F.col("_col") == cell_of(F.greatest("a_min_lon", "b_min_lon"), own_size)))
    c = F.col
    lat = F.greatest(F.least(c("a_max_lat"), c("b_max_lat")) - F.greatest(c("a_min_lat"), c("b_min_lat")), F.lit(0.0))
    lon = F.greatest(F.least(c("a_max_lon"), c("b_max_lon")) - F.greatest(c("a_min_lon"), c("b_min_lon")), F.lit(0.0))
    area = (c("b_max_lat") - c("b_min_lat")) * (c("b_max_lon") - c("b_min_lon"))
    holds = (c("a_min_lat") <= c("b_min_lat")) & (c("a_min_lon") <= c("b_min_lon")) & (c("a_max_lat") >= c("b_max_lat")) & (c("a_max_lon") >= c("b_max_lon"))
    covered = F.least(F.coalesce(F.try_divide(lat * lon, area), F.lit(0.0)), F.lit(1.0))
    return pairs.select("a_key", "b_key", ((lat > 0) & (lon > 0)).alias("intersects"), holds.alias("contains"), covered.alias("covered"))


def region_equals(prefix_a: str, prefix_b: str, tolerance: float = 1e-9) -> Column:
    return reduce(lambda x, y: x & y, [F.abs(F.col(f"{prefix_a}{k}") - F.col(f"{prefix_b}{k}")) <= tolerance for k in BOX])


def region_expand(regions: DataFrame, margin: float) -> DataFrame:
    """The box grown by a margin in degrees, cut to the world."""
    return regions.withColumns({
        "min_lat": F.greatest(F.col("min_lat") - margin, F.lit(-90.0)),
        "min_lon": F.greatest(F.col("min_lon") - margin, F.lit(-180.0)),
        "max_lat": F.least(F.col("max_lat") + margin, F.lit(90.0)),
        "max_lon": F.least(F.col("max_lon") + margin, F.lit(180.0)),
    })


def region_key() -> Column:
    """Text key of a box, to seven digits."""
    return F.format_string("%.7f,%.7f,%.7f,%.7f", *[F.col(k) for k in BOX])


def tile_bounds(tiles: DataFrame) -> DataFrame:
    """dem_tiles (width, height, gt) → adds the box and arc_seconds."""
    gt = F.col("gt")
    lon1, lat1 = gt[0] + F.col("width") * gt[1], gt[3] + F.col("height") * gt[5]
    return tiles.withColumns({"min_lat": F.least(gt[3], lat1), "max_lat": F.greatest(gt[3], lat1), "min_lon": F.least(gt[0], lon1), "max_lon": F.greatest(gt[0], lon1), "arc_seconds": F.abs(gt[1]) * 3600})


def dem_coverage(tiles: DataFrame, regions: DataFrame) -> DataFrame:
    """Share of each region that each tile covers, where they touch: tile_id, region_key, covered."""
    own = tile_bounds(tiles).withColumn("region_key", F.col("tile_id"))
    return box_relations(own, regions).select(F.col("a_key").alias("tile_id"), F.col("b_key").alias("region_key"), "covered")


def dem_contains(points: DataFrame, tiles: DataFrame) -> DataFrame:
    return points_in_region(points, tile_bounds(tiles))
