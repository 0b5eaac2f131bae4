"""Queries over rasters, boxes, wall meshes and tables of settings, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.functions import geo
from citygeo.functions.numbers import scaled
from citygeo.operators import graph as G
from citygeo.operators import graph_queries as N
from citygeo.operators import materials as K
from citygeo.operators import mesh as M
from citygeo.operators import region as R
from citygeo.operators import terrain as E
from citygeo.operators import thermal as H
from citygeo.operators.quality import dem_stats
from citygeo.operators.spatial import dealt
from citygeo.plans import map_queries, world_queries
from citygeo.plans.map_queries import BASE, MM
from citygeo.sources import lens

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- rasters

_STEP, _SIDE, _ACROSS = world_queries._STEP, world_queries._SIDE, world_queries._ACROSS
_wide = lambda spark: spark.createDataFrame([_WIDE], "region_key string, min_lat double, min_lon double, max_lat double, max_lon double")
_MICRO = lambda x: f"cast(floor({x} * 1e6 + 0.5) as bigint)"
_WIDE = ("all", 2.975, 77.0, 22.975, 93.0)  # a region that holds the lens and all tiles
# Tiles with their box, number of lines and range of heights.
_TILES = f"""with {world_queries._DEM}, tile as (select 't' || tile as tile_id, tile, max(r) + 1 as h, {world_queries._LAT0}::double - {world_queries._SOUTH} as north, {world_queries._LON0}::double + {world_queries._EASTWARD} as west,
 min(elev) filter (where elev > -9000) as low, max(elev) as high from dem group by tile)"""


@query(_TILES + f" select tile_id, {MM(f'{_STEP!r}::double * 11132000')} as north_um, {MM(f'{_STEP!r}::double * 11132000 * cos(radians(north - h * {_STEP!r}::double / 2))')} as east_um, {MM(f'{_STEP!r}::double * 3600')} as milli_arcsec from tile")
def dem_pixel_sizes(spark, d):
    _, tiles = world_queries.dem(spark, d)
    return E.dem_pixel_size_cm(tiles).select("tile_id", scaled(F.col("pixel_north_cm")).alias("north_um"), scaled(F.col("pixel_east_cm")).alias("east_um"), scaled(F.col("arc_seconds")).alias("milli_arcsec"))


@query(_TILES + " select tile_id, r::int as row, c::int as col, elev::bigint as elev from dem join tile using (tile) where r % greatest(h // 10, 1) = 0 and c % 5 = 0")
def dem_thinned(spark, d):
    pixels, tiles = world_queries.dem(spark, d)
    return E.thin_dem(pixels, tiles, lines=10).select("tile_id", "row", "col", F.col("elev").cast("long").alias("elev"))


@query(_TILES + f""", p as (select tile_id, r, c, elev, radians(north - (r + 0.5) * {_STEP!r}::double) as lat, radians(west + (c + 0.5) * {_STEP!r}::double) as lon from dem join tile using (tile)),
k as (select *, (1 / 298.257223563::double) * (2 - 1 / 298.257223563::double) as e2, radians(12.975::double) as lat0, radians(77.607::double) as lon0 from p),
n as (select *, 6378137.0::double / sqrt(1 - e2 * sin(lat) * sin(lat)) as n, 6378137.0::double / sqrt(1 - e2 * sin(lat0) * sin(lat0)) as n0 from k),
x as (select *, (n + elev) * cos(lat) * cos(lon) - (n0 + 900) * cos(lat0) * cos(lon0) as dx, (n + elev) * cos(lat) * sin(lon) - (n0 + 900) * cos(lat0) * sin(lon0) as dy, (n * (1 - e2) + elev) * sin(lat) - (n0 * (1 - e2) + 900) * sin(lat0) as dz from n where elev > -9000)
select tile_id, r::int as row, c::int as col, cast(floor(cos(lon0) * dy - sin(lon0) * dx + 0.5) as bigint) as east_m, cast(floor(cos(lat0) * dz - sin(lat0) * cos(lon0) * dx - sin(lat0) * sin(lon0) * dy + 0.5) as bigint) as north_m from x""")
def dem_pixels_placed(spark, d):
    pixels, tiles = world_queries.dem(spark, d)
    own = E.dem_pixel_world(pixels.filter("elev > -9000"), tiles, 12.975, 77.607, 900.0)
    return own.select("tile_id", "row", "col", *[scaled(F.col(f"enu.{k}").cast("double") / 100, 1).alias(f"{k}_m") for k in ("east", "north")])


@query(_TILES + f""", s as (select *, h * {_STEP!r}::double as tall, 50 * {_STEP!r}::double as wide from tile), m as (select *, 111320.0 * tall as a, 111320.0 * cos(radians(12.975)) * wide as b from s)
select tile_id, {MM('2 * (a + b)')} as length_mm, cast(floor(a * b + 0.5) as bigint) as area_m2, {_MICRO('(north - tall / 2)')} as lat_u, {_MICRO('(west + wide / 2)')} as lon_u, low::bigint as min_elev, high::bigint as max_elev,
 case when high > low then '' else 'node.terrain.norelief' end as flags from m""")
def terrain_nodes(spark, d):
    pixels, tiles = world_queries.dem(spark, d)
    own = G.terrain_nodes(tiles, dem_stats(pixels, tiles), _wide(spark))
    metric = lambda k: F.col(f"metrics.{k}")
    return own.select(
        F.col("name").alias("tile_id"), scaled(metric("length_m")).alias("length_mm"), scaled(metric("area_m2"), 1).alias("area_m2"), scaled(metric("centroid.lat"), 1_000_000).alias("lat_u"), scaled(metric("centroid.lon"), 1_000_000).alias("lon_u"),
        metric("min_elev").cast("long").alias("min_elev"), metric("max_elev").cast("long").alias("max_elev"), F.array_join("flags", ",").alias("flags"),
    )


@query(_TILES + f""", {map_queries._REG}, b as (select *, north - h * {_STEP!r}::double as south, west + 50 * {_STEP!r}::double as east from tile),
o as (select tile_id, region_key, greatest(least(north, r.c) - greatest(south, r.a), 0) * greatest(least(east, r.d) - greatest(west, r.b), 0) / ((r.c - r.a) * (r.d - r.b)) as share from b join regs r on south <= r.c and r.a <= north and west <= r.d and r.b <= east)
select tile_id, region_key, {MM('least(share, 1)')} as covered_e3 from o""")
def dem_coverage(spark, d):
    _, tiles = world_queries.dem(spark, d)
    return R.dem_coverage(tiles, lens.regions(spark)).select("tile_id", "region_key", scaled(F.col("covered")).alias("covered_e3"))


@query(_TILES + f""", q as (select o_orderkey as point_id, {world_queries._LAT0}::double - (o_orderkey * 37 % 3001) / 100000.0::double - 0.0000013 as lat, {world_queries._LON0}::double + (o_orderkey * 53 % 9001) / 100000.0::double + 0.0000017 as lon from orders)
select tile_id, count(*) as points from q join tile on lat between north - h * {_STEP!r}::double and north and lon between west and west + 50 * {_STEP!r}::double group by tile_id""")
def dem_contains(spark, d):
    _, tiles = world_queries.dem(spark, d)
    k = F.col("o_orderkey")
    points = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("point_id"), (F.lit(world_queries._LAT0) - (k * 37 % 3001) / 100000.0 - 0.0000013).alias("lat"), (F.lit(world_queries._LON0) + (k * 53 % 9001) / 100000.0 + 0.0000017).alias("lon"))
    return R.dem_contains(points, tiles).groupBy("tile_id").agg(F.count("*").alias("points"))


# --- boxes

@query("""with b as (select cast(c_custkey as bigint) as id, (c_custkey * 37 % 18000) / 100.0::double - 90 as lat, (c_custkey * 53 % 36000) / 100.0::double - 180 as lon from customer),
g as (select *, greatest(lat - 0.5, -90) as a, greatest(lon - 0.5, -180) as b, least(lat + 0.75, 90) as c, least(lon + 0.75, 180) as d from b)
select id, printf('%.7f,%.7f,%.7f,%.7f', a, b, c, d) as key, id % 3 < 2 as same from g""")
def region_keys(spark, d):
    """Boxes grown by half a degree, their keys, and whether they equal a box moved by no, 0.6 or 1.2 billionths of a degree."""
    i = F.col("c_custkey").cast("long")
    lat, lon = (i * 37 % 18000) / 100 - 90, (i * 53 % 36000) / 100 - 180
    own = spark.read.parquet(f"{d}/customer.parquet").select(i.alias("id"), lat.alias("min_lat"), lon.alias("min_lon"), (lat + 0.25).alias("max_lat"), (lon + 0.25).alias("max_lon"))
    grown = R.region_expand(own, 0.5).withColumn("key", R.region_key())
    moved = grown.withColumns({f"moved_{k}": F.col(k) + (F.col("id") % 3) * 6e-10 for k in R.BOX})
    return moved.select("id", "key", R.region_equals("", "moved_").alias("same"))


# --- graph and settings


@query(BASE + f""", {_TILES.removeprefix('with ')}, kinds as (select node_type from node union all select 'Junction' from jun union all select 'TerrainTile' from tile)
select node_type, count(*) as nodes, case node_type when 'Building' then 1 when 'RoadSegment' then 2 when 'WaterBody' then 4 when 'Waterway' then 5 when 'VegetationArea' then 6 when 'LanduseZone' then 7
 when 'Junction' then 3 when 'LeisureArea' then 8 when 'Railway' then 9 when 'Barrier' then 10 when 'PowerLine' then 11 when 'Amenity' then 12 when 'TerrainTile' then 13 end::bigint as position from kinds group by node_type""")
def present_types(spark, d):
    pixels, tiles = world_queries.dem(spark, d)
    region = _wide(spark)
    terrain = G.terrain_nodes(tiles, dem_stats(pixels, tiles), region)
    graph = G.build_city_graph(map_queries.placed(spark, d), region, map_queries.MID, terrain=terrain)
    return N.present_types(graph["nodes"]).select("node_type", "nodes", F.col("position").cast("long").alias("position"))


_PRESET = "preset(category, kelvin) as (values " + ", ".join(f"('{c}', {t}::double)" for c, t in zip(K.CATEGORIES, H.PRESETS["afternoon"])) + ")"


@query(world_queries._MATERIAL + f", {_PRESET} select category, count(*) as nodes, max(cast(floor(kelvin * 10 + 0.5) as bigint)) as temp_dk from mat join preset on category = wall group by category")
def preset_temps(spark, d):
    own = K.resolve_materials(map_queries.nodes(spark, d)).select(F.col("dominant").alias("category"))
    preset = H.preset_temps(spark, "afternoon").select("category", "temp_k")  # 16 rows
    return own.join(F.broadcast(preset), "category").groupBy("category").agg(F.count("*").alias("nodes"), F.max(scaled(F.col("temp_k"), 10)).alias("temp_dk"))


@query(world_queries._MATERIAL + " select count(*) as sections, count(distinct way_id) as components, count(*) filter (where wall not in ('Concrete', 'Brick', 'Metal', 'Glass')) as missing_visual, count(*) filter (where wall in ('Brick', 'Glass')) as missing_physical from mat")
def palette_changes(spark, d):
    columns = "category string, visual string, physical string"
    palette = spark.createDataFrame([("Concrete", "v1", "p1"), ("Brick", "v2", "p2"), ("Metal", "v3", None)], columns)
    changed = K.upsert_palette(palette, spark.createDataFrame([("Brick", "v5", None), ("Metal", "v6", "p6"), ("Glass", "v7", None)], columns))
    own = K.resolve_materials(map_queries.nodes(spark, d)).select(F.col("osm_id").alias("owner"), F.lit(0).alias("section"), F.col("dominant").alias("category"))
    return K.material_gaps(own, changed)


# --- walls

_HIGH = """greatest(case when height = '12.5 m' then 12.5 when levels = '4' then 12 when levels = '6 floors' then 18 else case when value in ('house','detached') then 8 when value = 'apartments' then 18
 when value = 'office' then 30 when value = 'commercial' then 15 when value in ('garage','shed') then 3.5 else 9 end end, 0.5)"""
_WALLS = BASE + f""", house as (select *, {_HIGH} as high, area_m2 * cos(radians(12.97)) / cos(radians({map_queries.MID})) >= 0.5 as good from node where kind < 2),
side as (select e.*, h.high, case when 360 < h.high * 100 - 1 then 2 else 1 end as bands, sqrt(power((bx - ax) * 111320, 2) + power((by2 - ay) * 111320.0 * cos(radians(12.97)), 2)) as len from ed e join house h using (way_id) where h.good)"""


def rings(spark: SparkSession, d: str) -> DataFrame:
    return world_queries.flat_rings(spark, d, "Building").select("node_id", "points", "height_m")


def wall_quads(rings: DataFrame) -> DataFrame:
    """The walls of buildings, whose heights go along with their rings."""
    return M.wall_quads(M.facade_bays(M.normalise_footprint(rings)[0]))


@query(_WALLS + f""", b as (select way_id, any_value(bands) as m, sum(greatest(floor(len / 3 + 0.5), 1)) as n, sum(len) * any_value(high) as area from side where len >= 0.05 group by way_id)
select way_id as mesh_id, cast(n * (3 * m + 1) as bigint) as edges, cast(2 * n as bigint) as open_edges, 0::bigint as crowded_edges, cast(floor(area * 100 + 0.5) as bigint) as area_dm2 from b""")
def wall_checks(spark, d):
    """Walls about a ring of n bays in m bands have n uprights, n diagonals a band, n level edges at each height; the first and last
    of these are open."""
    together = dealt(rings(spark, d), M.MOST_MESHES, "node_id")
    return M.face_checks(M.quad_faces(wall_quads(together))).select("mesh_id", "edges", "open_edges", "crowded_edges", scaled(F.col("area_m2"), 100).alias("area_dm2"))


@query(_WALLS + f" select way_id as mesh_id, 0::bigint as min_z, max({MM('high / 10')}) as max_z_cm, min({MM('(ax - 12.97) * 111320')}) as min_x_mm, max({MM('(ay - 77.602) * 111320.0 * cos(radians(12.97))')}) as max_y_mm from side where len >= 0.05 group by way_id")
def wall_bounds(spark, d):
    box = M.mesh_bounds(M.quad_mesh(wall_quads(rings(spark, d)))[0])  # read once: no vertex is numbered or kept
    return box.select("mesh_id", scaled(F.col("min_z"), 1).alias("min_z"), scaled(F.col("max_z"), 1).alias("max_z_cm"), scaled(F.col("min_x"), 10).alias("min_x_mm"), scaled(F.col("max_y"), 10).alias("max_y_mm"))


@query(_WALLS + " select way_id as mesh_id, 2 * sum(greatest(floor(len / 3 + 0.5), 1))::bigint as triangles from side where len >= 0.05 and bands = 2 group by way_id")
def upper_walls(spark, d):
    _, triangles = M.quad_mesh(wall_quads(rings(spark, d)))
    return M.mesh_section(triangles, "Wall").groupBy("mesh_id").agg(F.count("*").alias("triangles"))


@query(_WALLS + " select 'Building' as kind, case when good then '' else 'footprint is a sliver' end as reason, count(*) as count from house group by 2")
def build_tally(spark, d):
    good, bad = M.normalise_footprint(world_queries.flat_rings(spark, d, "Building").select("node_id", "points"))
    kind = F.lit("Building").alias("kind")
    return M.build_tally(good.select(kind), bad.select(kind, "reason"))
