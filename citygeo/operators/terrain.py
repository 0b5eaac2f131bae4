"""Elevation rasters as pixel tables, and regular terrain grids.

terrain(region_key, lat0, lon0, min_x, min_y, step_x, step_y, div_x, div_y, base_elev) describes a grid;
grid(region_key, ix, iy, x_m, y_m, height_cm) has its nodes. x points north, y east, in metres about (lat0, lon0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citygeo.functions.geo import from_local_m, latlon_to_pixel, pixel_to_latlon, to_enu_cm, from_enu_cm
from citygeo.functions.numbers import clamp, nearest
from citygeo.operators.cut import cut
from citygeo.operators.region import tile_bounds
from citygeo.operators.spatial import few

MIN_DIV, MAX_DIV, LEAST_GAP_M = 16, 512, 0.001
HEADER = ["lat0", "lon0", "min_x", "min_y", "step_x", "step_y", "div_x", "div_y"]


def sample_elevation(points: DataFrame, pixels: DataFrame, tiles: DataFrame, default: float | None = None, key: str = "point_id") -> DataFrame:
    """Adds elev to points (key, tile_id, lat, lon): bilinear over four pixels, void corners filled with the mean of the others;
    null (or the default) outside or where all are void. Four rows a point meet the pixels in one equi-join."""
    meta = tiles.select("tile_id", "gt", "width", "height", "nodata", "has_nodata")
    own = points.join(meta, "tile_id").withColumn("_p", latlon_to_pixel(F.col("lat"), F.col("lon"), F.col("gt")))
    col, row = F.col("_p.col"), F.col("_p.row")
    inside = col.between(0, F.col("width") - 1) & row.between(0, F.col("height") - 1)
    c0, r0 = F.floor(col).cast("int"), F.floor(row).cast("int")
    c1, r1 = F.least(c0 + 1, F.col("width") - 1), F.least(r0 + 1, F.col("height") - 1)
    corner = lambda c, r, w: F.struct(c.alias("col"), r.alias("row"), w.alias("w"))
    tc, tr = col - c0, row - r0
    corners = F.array(corner(c0, r0, (1 - tc) * (1 - tr)), corner(c1, r0, tc * (1 - tr)), corner(c0, r1, (1 - tc) * tr), corner(c1, r1, tc * tr))
    four = own.filter(inside).select(key, "tile_id", "nodata", "has_nodata", F.explode(corners).alias("_c"))
    four = four.select(key, "tile_id", "nodata", "has_nodata", F.col("_c.col").alias("col"), F.col("_c.row").alias("row"), F.col("_c.w").alias("w"))
    met = four.join(pixels.select("tile_id", "row", "col", F.col("elev").cast("double").alias("elev")), ["tile_id", "row", "col"], "left")
    ok = F.col("elev").isNotNull() & ~F.isnan("elev") & ~(F.col("has_nodata") & (F.abs(F.col("elev") - F.col("nodata")) < 0.5))
    met = met.withColumn("v", F.when(ok, F.col("elev")))
    agg = met.groupBy(key).agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("w"))), F.lit(0.0)).alias("void"), F.avg("v").alias("mean"))
    found = agg.select(key, (F.coalesce(F.col("s"), F.lit(0.0)) + F.col("void") * F.col("mean")).alias("elev"))
    out = points.join(found, key, "left")
    return out if default is None else out.withColumn("elev", F.coalesce("elev", F.lit(default)))


def terrain_frame(bounds: DataFrame, quad_m: float) -> DataFrame:
    """bounds (region_key, lat0, lon0, min_x, min_y, max_x, max_y) → grid header. Boxes without extent give none."""
    size = lambda a: F.col(f"max_{a}") - F.col(f"min_{a}")
    div = lambda a: clamp(nearest(size(a) / max(quad_m, 1.0)), MIN_DIV, MAX_DIV).cast("int")
    own = bounds.filter((size("x") > 0) & (size("y") > 0)).withColumns({"div_x": div("x"), "div_y": div("y")})
    return own.withColumns({"step_x": size("x") / F.col("div_x"), "step_y": size("y") / F.col("div_y")})


def terrain_grid(frame: DataFrame, pixels: DataFrame | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """Grid nodes with heights in cm above the raster's least: 0 where void, flat without a raster. frame has tile_id if there is one."""
    ranges = frame.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("div_x")))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("div_y"))))
    own = ranges.withColumns({"x_m": F.col("min_x") + F.col("ix") * F.col("step_x"), "y_m": F.col("min_y") + F.col("iy") * F.col("step_y")})
    if pixels is None or tiles is None:
        return own.select("region_key", "ix", "iy", "x_m", "y_m", F.lit(0.0).alias("height_cm"))
    box = tile_bounds(tiles).select("tile_id", *[F.col(c).alias(f"_{c}") for c in ("min_lat", "min_lon", "max_lat", "max_lon")])
    least = pixels.join(tiles.select("tile_id", "nodata", "has_nodata"), "tile_id").filter(~(F.col("has_nodata") & (F.abs(F.col("elev") - F.col("nodata")) < 0.5))).groupBy("tile_id").agg(F.min(F.col("elev").cast("double")).alias("base"))
    placed = own.join(box, "tile_id").withColumn("_ll", from_local_m(F.col("x_m"), F.col("y_m"), F.col("lat0"), F.col("lon0")))
    points = placed.select("region_key", "tile_id", "ix", "iy", "x_m", "y_m", F.concat_ws("/", "region_key", "ix", "iy").alias("point_id"), clamp(F.col("_ll.lat"), F.col("_min_lat"), F.col("_max_lat")).alias("lat"), clamp(F.col("_ll.lon"), F.col("_min_lon"), F.col("_max_lon")).alias("lon"))
    high = sample_elevation(points, pixels, tiles).join(least, "tile_id", "left")
    return high.select("region_key", "ix", "iy", "x_m", "y_m", F.coalesce((F.col("elev") - F.col("base")) * 100, F.lit(0.0)).alias("height_cm"))


def terrain_height(points: DataFrame, frame: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds height_cm to points (region_key, x_m, y_m): on the triangle of the cell cut from its low to its high corner, points beyond
    the grid moved to its edge. A point meets the four heights of its cell in one row, so points are neither multiplied nor grouped."""
    own = points.join(few(frame.select("region_key", *[F.col(c).alias(f"_{c}") for c in HEADER[2:]])), "region_key", "left")
    local = lambda a: clamp((F.col(f"{a}_m") - F.col(f"_min_{a}")) / F.col(f"_step_{a}"), F.lit(0.0), F.col(f"_div_{a}").cast("double"))
    own = own.withColumns({"_lx": local("x"), "_ly": local("y")})
    own = own.withColumns({"_cx": F.least(F.floor("_lx").cast("int"), F.col("_div_x") - 1), "_cy": F.least(F.floor("_ly").cast("int"), F.col("_div_y") - 1)})
    own = own.withColumns({"_fx": F.col("_lx") - F.col("_cx"), "_fy": F.col("_ly") - F.col("_cy")})
    fx, fy = F.col("_fx"), F.col("_fy")
    upper = fy >= fx
    weights = {
        "_h00": F.when(upper, 1 - fy).otherwise(1 - fx), "_h01": F.when(upper, fy - fx).otherwise(0.0),
        "_h11": F.when(upper, fx).otherwise(fy), "_h10": F.when(upper, 0.0).otherwise(fx - fy),
    }
    height = sum((w * F.coalesce(F.col(h), F.lit(0.0)) for h, w in weights.items()), F.lit(0.0))  # a corner that the grid lacks adds nothing
    met = own.join(few(cut(_cells(grid))), ["region_key", "_cx", "_cy"], "left")
    return met.select(*[F.col(c) for c in points.columns], F.coalesce(height, F.lit(0.0)).alias("height_cm"))


def _cells(grid: DataFrame) -> DataFrame:
    """region_key, _cx, _cy (a cell's low corner), and the heights of its corners: _h00, _h01 (iy + 1), _h11, _h10 (ix + 1)."""
    corners = [(0, 0), (0, 1), (1, 1), (1, 0)]
    of = F.explode(F.array(*[F.struct((F.col("ix") - x).alias("_cx"), (F.col("iy") - y).alias("_cy"), F.lit(f"_h{x}{y}").alias("k")) for x, y in corners]))
    rows = grid.select("region_key", "height_cm", of.alias("_c"))
    return rows.groupBy("region_key", "_c._cx", "_c._cy").agg(*[F.sum(F.when(F.col("_c.k") == f"_h{x}{y}", F.col("height_cm"))).alias(f"_h{x}{y}") for x, y in corners])


def _crossings(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Shares of the way from start to end, within 0 and 1, at which it passes a whole number from low to high: the lines of the
    grid, so there are no more than it has, however long the way."""
    first, last = F.greatest(F.floor(F.least(start, end)) + 1, low), F.least(F.ceil(F.greatest(start, end)) - 1, high)
    whole = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    shares = F.transform(whole, lambda k: F.try_divide(k - start, end - start))
    return F.filter(shares, lambda t: t.isNotNull() & (t > 0) & (t < 1))


def segments(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """lines (key, region_key, points array<struct<x, y>>, closed) → a row for each segment: seq, a, b."""
    follow = F.when(F.col("closed"), F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))).otherwise(F.slice("points", 2, F.size("points")))
    pairs = F.zip_with(F.slice(F.col("points"), F.lit(1), F.size(follow)), follow, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return lines.filter(F.size("points") > 1).select(key, "region_key", "closed", F.posexplode(pairs).alias("seq", "s")).select(key, "region_key", "closed", "seq", "s.a", "s.b")


def _with_crossings(parts: DataFrame, frame: DataFrame) -> DataFrame:
    own = parts.join(few(frame.select("region_key", *HEADER[2:])), "region_key")
    u = lambda p: (F.col(f"{p}.x") - F.col("min_x")) / F.col("step_x")
    v = lambda p: (F.col(f"{p}.y") - F.col("min_y")) / F.col("step_y")
    wide, high, none = F.col("div_x").cast("long"), F.col("div_y").cast("long"), F.lit(0).cast("long")
    diagonals = _crossings(v("a") - u("a"), v("b") - u("b"), -wide, high)
    shares = F.concat(_crossings(u("a"), u("b"), none, wide), _crossings(v("a"), v("b"), none, high), diagonals)
    return own.withColumn("_t", F.array_sort(shares))


def _at(t: Column) -> tuple[Column, Column]:
    return F.col("a.x") + (F.col("b.x") - F.col("a.x")) * t, F.col("a.y") + (F.col("b.y") - F.col("a.y")) * t


def split_at_triangles(lines: DataFrame, frame: DataFrame, key: str = "line_id") -> DataFrame:
    """key, region_key, pos, x_m, y_m: the points of lines and where they cross grid lines and diagonals; crossings nearer than a
    millimetre to the one before, or to the end, are merged. pos orders the points of a line."""
    own = _with_crossings(segments(lines, key), frame)
    length = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2))
    gap = F.when(length > 1e-8, F.try_divide(F.lit(LEAST_GAP_M), length)).otherwise(1.0)
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("kept"))

    def keep(acc: Column, t: Column) -> Column:
        take = (t - acc["last"] > gap) & (1 - t > gap)
        return F.when(take, F.struct(t.alias("last"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc)

    kept = F.concat(F.array(F.lit(0.0)), F.aggregate("_t", start, keep)["kept"])
    rows = own.select(key, "region_key", "seq", "a", "b", F.posexplode(kept).alias("k", "t"))
    x, y = _at(F.col("t"))
    out = rows.select(key, "region_key", F.struct("seq", "k").alias("pos"), x.alias("x_m"), y.alias("y_m"))
    ends = lines.filter(~F.col("closed") | (F.size("points") == 1)).filter(F.size("points") > 0)
    end = F.element_at("points", -1)
    return out.unionByName(ends.select(key, "region_key", F.struct(F.size("points").alias("seq"), F.lit(0).alias("k")).alias("pos"), end["x"].alias("x_m"), end["y"].alias("y_m")))


def _inside(x: Column, y: Column, ring: Column) -> Column:
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.aggregate(pairs, F.lit(False), lambda acc, e: acc != crosses(e))


def grid_nodes_in_polygon(polygons: DataFrame, frame: DataFrame, key: str = "line_id") -> DataFrame:
    """key, region_key, ix, iy, x_m, y_m of grid nodes inside polygons (points as in segments)."""
    own = polygons.filter(F.size("points") >= 3).join(few(frame.select("region_key", *HEADER[2:])), "region_key")
    low = lambda a: F.array_min(F.transform("points", lambda p: p[a]))
    high = lambda a: F.array_max(F.transform("points", lambda p: p[a]))
    first = lambda a: clamp(F.ceil((low(a) - F.col(f"min_{a}")) / F.col(f"step_{a}")), F.lit(0), F.col(f"div_{a}")).cast("int")
    last = lambda a: clamp(F.floor((high(a) - F.col(f"min_{a}")) / F.col(f"step_{a}")), F.lit(0), F.col(f"div_{a}")).cast("int")
    spans = own.filter((first("x") <= last("x")) & (first("y") <= last("y"))).withColumn("ix", F.explode(F.sequence(first("x"), last("x")))).withColumn("iy", F.explode(F.sequence(first("y"), last("y"))))
    spans = spans.withColumns({"x_m": F.col("min_x") + F.col("ix") * F.col("step_x"), "y_m": F.col("min_y") + F.col("iy") * F.col("step_y")})
    return spans.filter(_inside(F.col("x_m"), F.col("y_m"), F.col("points"))).select(key, "region_key", "ix", "iy", "x_m", "y_m")


def ground_range(polygons: DataFrame, frame: DataFrame, grid: DataFrame, key: str = "line_id") -> DataFrame:
    """key, min_cm, max_cm: exact, as extremes lie at vertices, where edges cross grid lines or diagonals, or at grid nodes inside."""
    closed = polygons.withColumn("closed", F.lit(True))
    edges = _with_crossings(segments(closed, key), frame).select(key, "region_key", "a", "b", F.explode(F.concat(F.array(F.lit(0.0)), "_t")).alias("t"))
    x, y = _at(F.col("t"))
    points = edges.select(key, "region_key", x.alias("x_m"), y.alias("y_m")).unionByName(grid_nodes_in_polygon(polygons, frame, key).select(key, "region_key", "x_m", "y_m"))
    return terrain_height(points, frame, grid).groupBy(key).agg(F.min("height_cm").alias("min_cm"), F.max("height_cm").alias("max_cm"))


def terrain_mesh(frame: DataFrame, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (region_key, vertex, x, y, z in cm) and triangles (region_key, triangle, a, b, c): two a cell, cut from its low to its high corner."""
    own = grid.join(frame.select("region_key", "div_x", "div_y"), "region_key")
    index = lambda ix, iy: (ix * (F.col("div_y") + 1) + iy).cast("long")
    ix, iy = F.col("ix"), F.col("iy")
    vertices = own.select("region_key", index(ix, iy).alias("vertex"), (F.col("x_m") * 100).alias("x"), (F.col("y_m") * 100).alias("y"), F.col("height_cm").alias("z"))
    a, b, c, d = index(ix, iy), index(ix, iy + 1), index(ix + 1, iy + 1), index(ix + 1, iy)
    two = F.array(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), F.struct(a.alias("a"), c.alias("b"), d.alias("c")))
    cells = own.filter((ix < F.col("div_x")) & (iy < F.col("div_y")))
    triangles = cells.select("region_key", ((ix * F.col("div_y") + iy) * 2).alias("cell"), F.posexplode(two).alias("k", "t")).select("region_key", (F.col("cell") + F.col("k")).cast("long").alias("triangle"), "t.a", "t.b", "t.c")
    return vertices, triangles


def thin_dem(pixels: DataFrame, tiles: DataFrame, lines: int = 64) -> DataFrame:
    """Every so many rows and columns, for a drawing of about ``lines`` lines a side."""
    step = lambda k: F.greatest(F.floor(F.col(k) / lines).cast("int"), F.lit(1))
    own = pixels.join(tiles.select("tile_id", step("height").alias("_r"), step("width").alias("_c")), "tile_id")
    return own.filter((F.col("row") % F.col("_r") == 0) & (F.col("col") % F.col("_c") == 0)).drop("_r", "_c")


def ground_bounds(points: DataFrame, regions: DataFrame, margin_m: float = 20.0) -> DataFrame:
    """points (region_key, x_m, y_m) and regions with their own box in metres → box of both, expanded."""
    own = points.groupBy("region_key").agg(*[f(f"{a}_m").alias(f"p{n}_{a}") for a in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    both = regions.join(own, "region_key", "left")
    low = {f"min_{a}": F.least(F.col(f"min_{a}"), F.col(f"pmin_{a}")) - margin_m for a in "xy"}
    high = {f"max_{a}": F.greatest(F.col(f"max_{a}"), F.col(f"pmax_{a}")) + margin_m for a in "xy"}
    return both.withColumns(low | high).drop(*[f"p{n}_{a}" for a in "xy" for n in ("min", "max")])


def dem_pixel_world(pixels: DataFrame, tiles: DataFrame, lat0: float, lon0: float, h0: float = 0.0) -> DataFrame:
    """Adds enu (cm, as doubles: rasters may lie far from the origin) of each pixel's centre about an origin."""
    own = pixels.join(tiles.select("tile_id", "gt"), "tile_id").withColumn("_ll", pixel_to_latlon(F.col("col"), F.col("row"), F.col("gt")))
    return own.withColumn("enu", to_enu_cm(F.col("_ll.lat"), F.col("_ll.lon"), F.col("elev").cast("double"), F.lit(lat0), F.lit(lon0), F.lit(h0), "double")).drop("gt", "_ll")


def dem_alignment_error(pixels: DataFrame, tiles: DataFrame, lat0: float, lon0: float, h0: float = 0.0) -> DataFrame:
    """Largest round-trip error of pixel centres, in arc-seconds, by tile."""
    own = dem_pixel_world(pixels, tiles, lat0, lon0, h0).join(tiles.select("tile_id", "gt"), "tile_id").withColumn("_ll", pixel_to_latlon(F.col("col"), F.col("row"), F.col("gt")))
    back = from_enu_cm(F.col("enu"), F.lit(lat0), F.lit(lon0), F.lit(h0))
    error = F.greatest(F.abs(back["lat"] - F.col("_ll.lat")), F.abs(back["lon"] - F.col("_ll.lon"))) * 3600
    return own.groupBy("tile_id").agg(F.max(error).alias("arc_seconds"))


def dem_pixel_size_cm(tiles: DataFrame) -> DataFrame:
    """Adds pixel_north_cm and pixel_east_cm at the tile's middle."""
    own = tile_bounds(tiles)
    mid = (F.col("min_lat") + F.col("max_lat")) / 2
    return own.withColumns({"pixel_north_cm": F.abs(F.col("gt")[5]) * 111320 * 100, "pixel_east_cm": F.abs(F.col("gt")[1]) * 111320 * 100 * F.cos(F.radians(mid))})
