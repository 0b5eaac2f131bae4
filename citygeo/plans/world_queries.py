"""Queries over materials, temperatures, terrain, meshes and coordinates, and the SQL that states the same."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.functions import geo
from citygeo.functions.numbers import leading_integer, leading_number, scaled
from citygeo.operators import graph as G
from citygeo.operators import materials as K
from citygeo.operators import mesh as M
from citygeo.operators import terrain as E
from citygeo.operators import thermal as H
from citygeo.operators.cut import checkpoint_folder, cut
from citygeo.operators.quality import dem_stats
from citygeo.plans.map_queries import BASE, MID, MM, listed, nodes
from citygeo.sources import lens
from citygeo.streaming.thermal_stream import zone_temperatures_stream as zone_temperatures_stream_of

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- materials

_ROAD = "case when surface = 'gravel' then 'Stone' else 'Asphalt' end"
_SURFACE = f"""case when kind = 2 then {_ROAD} when kind = 3 then 'Stone' when kind in (4, 5, 6) then 'Water' when kind = 7 then 'Vegetation'
 when kind = 8 then case value when 'forest' then 'Vegetation' when 'grass' then 'Grass' when 'farmland' then 'Soil' when 'industrial' then 'Concrete' else 'Soil' end
 when kind = 9 then case when value = 'pitch' and surface = 'gravel' then 'Stone' else 'Grass' end when kind = 10 then case value when 'parking' then 'Asphalt' else 'Concrete' end else 'Soil' end"""
_LEVELS = "case levels when '4' then 4 when '6 floors' then 6 else 0 end"
_WALL = f"""case when wall is not null then 'Brick' when value in ('office', 'commercial') then case when {_LEVELS} > 4 then 'Glass' else 'Concrete' end when value = 'warehouse' then 'Metal'
 when value in ('house', 'apartments', 'detached') then case when {_LEVELS} <= 3 then 'Plaster' else 'Concrete' end when value = 'garage' then 'CementBlock' else 'Concrete' end"""
_ROOF = "case when roof is not null then 'Stone' when value in ('warehouse', 'garage') then 'Metal' when value in ('house', 'detached') then 'RoofTile' else 'Concrete' end"
_MATERIAL = BASE + f", mat as (select way_id, kind, node_type, area_m2, case when kind < 2 then {_WALL} else {_SURFACE} end as wall, case when kind < 2 then {_ROOF} else {_SURFACE} end as roof, case when kind < 2 then case when shop is not null then 'Glass' else {_WALL} end when kind = 2 then {_ROAD} else 'Unknown' end as ground_floor from node)"
_PROPS = "props(category, code, emissivity, absorptivity, base_temp_k, conductivity_w, specific_heat, density, thickness_m) as (values " + ", ".join(f"('{c}', {i}, " + ", ".join(f"{v!r}::double" for v in row[:7]) + ")" for i, (c, row) in enumerate(zip(K.CATEGORIES, K.PROPERTY_ROWS))) + ")"


@query(_MATERIAL + " select way_id as osm_id, wall, roof, ground_floor, wall as dominant from mat")
def resolve_materials(spark, d):
    return K.resolve_materials(nodes(spark, d)).select("osm_id", "wall", "roof", "ground_floor", "dominant")


@query(_MATERIAL + f""", {_PROPS} select category, count(*) as nodes, max(cast(floor(sqrt(conductivity_w * density * specific_heat) * 1000 + 0.5) as bigint)) as inertia_e3, max(cast(floor(conductivity_w / (density * specific_heat) * 1e12 + 0.5) as bigint)) as diffusivity_e12,
 max(cast(floor(least(emissivity * power(base_temp_k / 373.15, 4) + (1 - emissivity) * power(293.15 / 373.15, 4), 1) * 1e6 + 0.5) as bigint)) as radiance_e6 from mat join props on props.category = mat.wall group by category""")
def material_physics(spark, d):
    own = K.resolve_materials(nodes(spark, d)).select(F.col("dominant").alias("category"))
    out = K.material_thermal(K.with_material_props(own))
    return out.groupBy("category").agg(F.count("*").alias("nodes"), F.max(scaled(F.col("inertia"))).alias("inertia_e3"), F.max(scaled(F.col("diffusivity"), 1_000_000_000_000)).alias("diffusivity_e12"), F.max(scaled(F.col("radiance"), 1_000_000)).alias("radiance_e6"))


@query("select variant, count(*) as rows from (select (((o_orderkey - 20000) % 7) + 7) % 7 as variant from orders) x group by variant")
def material_variants(spark, d):
    own = spark.read.parquet(f"{d}/orders.parquet").select(K.pick_variant(F.col("o_orderkey") - 20000, 7).alias("variant"))
    return own.groupBy("variant").agg(F.count("*").alias("rows"))


@query(_MATERIAL + " select count(*) as sections, count(distinct way_id) as components, count(*) filter (where wall not in ('Concrete', 'Brick', 'Metal', 'Asphalt')) as missing_visual, count(*) filter (where wall in ('Metal', 'Asphalt')) as missing_physical from mat")
def material_gaps(spark, d):
    palette = spark.createDataFrame([("Concrete", "v1", "p1"), ("Brick", "v2", "p2"), ("Metal", "v3", None), ("Asphalt", "v4", None)], "category string, visual string, physical string")
    own = K.resolve_materials(nodes(spark, d)).select(F.col("osm_id").alias("owner"), F.lit(0).alias("section"), F.col("dominant").alias("category"))
    return K.material_gaps(own, palette)


_ASSET_NAMES = ["watertank_plastic", "SOLARPANEL", "AC_Unit", "window_recessed", "streetlamp", "unknown"]


@query("with a(name, slot, category) as (values ('watertank_plastic', 0, 'Plastic'), ('SOLARPANEL', 0, 'Glass'), ('SOLARPANEL', 1, 'Metal'), ('SOLARPANEL', 2, 'Metal'), ('AC_Unit', 0, 'Metal'), ('AC_Unit', 1, 'Metal'), ('window_recessed', 0, 'Metal'), ('window_recessed', 1, 'Glass'), ('streetlamp', 0, 'Metal'), ('streetlamp', 1, 'Glass')), p as (select case p_partkey % 6 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_ASSET_NAMES)) + " end as name from part) select p.name, slot, category, count(*) as parts from p join a on a.name = p.name group by 1, 2, 3")
def asset_slots(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in _ASSET_NAMES]), (F.col("p_partkey") % 6).cast("int") + 1)
    own = spark.read.parquet(f"{d}/part.parquet").select(name.alias("name"))
    return K.describe_assets(own, "name").groupBy("name", "slot", "category").agg(F.count("*").alias("parts"))


# --- temperatures; readings are events, zones are users

_HOUR = "(extract(hour from ts) + extract(minute from ts) / 60.0::double)"
_ENV = f"""env as (select event_id, user_id as zone_id, ts, h, case when h < 6 or h > 18 then 0 else sin((h - 6) / 12 * pi()) * 1000 end as irradiance, case when h < 6 or h > 18 then 298.15::double
 else 298.15::double + sin(least(greatest((h - 8) / 12 * pi(), 0), pi())) * 15 end as ambient_k from (select event_id, user_id, ts, {_HOUR} as h from events) e)"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("zone_id"), "event_id", "ts")
    own = H.environment(events, F.hour("ts") + F.minute("ts") / 60.0)
    return own.withColumns({"dt_s": F.lit(600.0), "sky_k": F.col("ambient_k") - 10, "wind": (F.col("event_id") % 5).cast("double")})


def zones(spark: SparkSession, d: str) -> DataFrame:
    users = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("zone_id")).distinct()
    category = F.element_at(F.array(*[F.lit(c) for c in K.CATEGORIES[1:]]), F.pmod("zone_id", F.lit(15)).cast("int") + 1)
    own = users.withColumns({"category": category, "normal": F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))})
    return K.with_material_props(own).withColumn("temp_k", F.col("base_temp_k"))


@query(f"with {_ENV} select event_id, cast(floor(irradiance * 1000 + 0.5) as bigint) as irradiance_mw, cast(floor(ambient_k * 1000 + 0.5) as bigint) as ambient_mk from env")
def environment(spark, d):
    return readings(spark, d).select("event_id", scaled(F.col("irradiance")).alias("irradiance_mw"), scaled(F.col("ambient_k")).alias("ambient_mk"))


@query(f"""with {_ENV}, {_PROPS}, z as (select e.*, p.*, 5.7::double + 3.8::double * (event_id % 5) as conv from env e join props p on p.code = zone_id % 15 + 1)
select event_id, category, cast(floor(absorptivity * irradiance * case when h < 6 or h > 18 then 0 else sin((h - 6) / 12 * pi()) end * 1000 + 0.5) as bigint) as solar_mw, cast(floor(conv * (base_temp_k - ambient_k) * 1000 + 0.5) as bigint) as convective_mw,
 cast(floor(emissivity * 5.670374419e-8::double * (base_temp_k * base_temp_k * base_temp_k * base_temp_k - power(ambient_k - 10, 4)) * 1000 + 0.5) as bigint) as radiative_mw from z""")
def zone_flux(spark, d):
    own = H.zone_flux(readings(spark, d).join(zones(spark, d), "zone_id"))
    return own.select("event_id", "category", *[scaled(F.col(f"flux.{k}")).alias(f"{k}_mw") for k in ("solar", "convective", "radiative")])


_LAST_TEMPS = f"""with recursive {_ENV}, {_PROPS}, one as (select * from env qualify row_number() over (partition by zone_id, ts order by event_id % 5) = 1), r as (select *, row_number() over (partition by zone_id order by ts) as k from one),
t(zone_id, k, temp) as (select u.zone_id, 0::bigint, base_temp_k from (select distinct zone_id from env) u join props p on p.code = zone_id % 15 + 1
 union all select t.zone_id, r.k, least(greatest(temp + least(greatest((absorptivity * irradiance * case when h < 6 or h > 18 then 0 else sin((h - 6) / 12 * pi()) end - emissivity * 5.670374419e-8::double * (temp * temp * temp * temp - power(ambient_k - 10, 4))
 - (5.7::double + 3.8::double * (event_id % 5)) * (temp - ambient_k)) / (density * specific_heat * thickness_m) * 600, -50), 50), 220), 420) from t join r on r.zone_id = t.zone_id and r.k = t.k + 1 join props p on p.code = t.zone_id % 15 + 1)
select zone_id, cast(floor(arg_max(temp, k) * 100 + 0.5) as bigint) as temp_ck from t group by zone_id"""


@query(_LAST_TEMPS)
def zone_temperatures(spark, d):
    own = readings(spark, d)
    return H.zone_temperatures(zones(spark, d), own).select("zone_id", scaled(F.col("temp_k"), 100).alias("temp_ck"))


@query(_LAST_TEMPS)
def zone_temperatures_stream(spark, d):
    """The same over a stream of two batches: all readings, shuffled, and one of a zone of its own much later, which ends the waiting."""
    folder = f"{checkpoint_folder(spark)}/readings-{uuid.uuid4().hex}"
    own = readings(spark, d).select("zone_id", "ts", "dt_s", *H.READING)
    last = own.agg(F.max("ts").alias("ts")).filter("ts is not null")  # one row
    last = last.select(F.lit(-1).cast(own.schema["zone_id"].dataType).alias("zone_id"), (F.col("ts") + F.expr("interval 100 days")).alias("ts"), *[F.lit(0.0).alias("dt_s") if c == "dt_s" else F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ["dt_s", *H.READING]])
    own.write.parquet(f"{folder}/in/k=0")
    last.write.parquet(f"{folder}/in/k=1")
    every = zones(spark, d)
    every = every.unionByName(every.limit(1).withColumn("zone_id", F.lit(-1).cast(every.schema["zone_id"].dataType)))
    stream = spark.readStream.schema(own.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")
    found = zone_temperatures_stream_of(every, stream, "50 days")
    run = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{folder}/out").filter("zone_id >= 0")
    return out.groupBy("zone_id").agg(F.max_by("temp_k", "ts").alias("temp_k")).select("zone_id", scaled(F.col("temp_k"), 100).alias("temp_ck"))


@query(_MATERIAL + f", {_PROPS}, z as (select wall as category from mat where kind < 2 union all select roof from mat where kind < 2 union all select wall from mat where kind >= 2) select p.code::int as code, p.category, count(z.category) as zones, cast(floor(case when count(z.category) > 0 then base_temp_k else 293.15 end * 1000 + 0.5) as bigint) as temp_mk from props p left join z on z.category = p.category group by p.code, p.category, base_temp_k")
def category_temps(spark, d):
    return H.category_temps(H.thermal_zones(nodes(spark, d))).select("code", "category", "zones", scaled(F.col("temp_k")).alias("temp_mk"))


@query("with z as (select c_custkey as zone_id, (c_custkey * 13 % 1000)::double as x, (c_custkey * 29 % 1000)::double as y, (c_custkey % 30)::double as z from customer), s as (select s_suppkey as sensor_id, (s_suppkey * 71 % 1000)::double as x, (s_suppkey * 37 % 1000)::double as y, 10.0::double as z from supplier) select zone_id, sensor_id from z join s on power(z.x - s.x, 2) + power(z.y - s.y, 2) + power(z.z - s.z, 2) <= 2500")
def zones_near(spark, d):
    place = lambda k, a, b, z: [((F.col(k) * a) % 1000).cast("double").alias("x"), ((F.col(k) * b) % 1000).cast("double").alias("y"), z.cast("double").alias("z")]
    own = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("zone_id"), *place("c_custkey", 13, 29, F.col("c_custkey") % 30))
    far = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("sensor_id"), *place("s_suppkey", 71, 37, F.lit(10.0)))
    return H.zones_near(own, far, 50.0)


# --- terrain: tiles of 50 by 50 pixels, a pixel a second of arc, derived from part keys; the first lies over the region

_DEM = """dem as (select k // 2500 as tile, k // 50 % 50 as r, k % 50 as c, case when (k // 50 * 31 + k % 50) % 97 = 0 then -9999.0::double else 900.0::double + (k // 50 * 7 + k % 50 * 13) % 40 end as elev
  from (select p_partkey::bigint - 1 as k from part where p_partkey >= 1) p)"""
_STEP = 0.0003
_LON0, _LAT0 = 77.601, 12.983


_SIDE, _ACROSS = 50, 1000  # pixels a side; tiles from west to east, then further south


def _south(tile):
    return F.floor(tile / _ACROSS) * (_SIDE * _STEP)


def _east(tile):
    return F.pmod(tile, F.lit(_ACROSS)) * (_SIDE * _STEP)


def _tile_id(tile):
    return F.concat(F.lit("t"), tile.cast("string"))


def dem(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pixels of all tiles, one for each part key from 1 on, 2,500 a tile."""
    k = F.col("p_partkey").cast("long") - 1
    keys = spark.read.parquet(f"{d}/part.parquet").filter(k >= 0).select(F.floor(k / _SIDE**2).alias("tile"), F.floor(k / _SIDE).alias("line"), F.pmod(k, F.lit(_SIDE)).cast("int").alias("col"))
    keys = keys.withColumn("row", F.pmod("line", F.lit(_SIDE)).cast("int"))
    value = F.when((F.col("line") * 31 + F.col("col")) % 97 == 0, -9999.0).otherwise(900.0 + (F.col("line") * 7 + F.col("col") * 13) % 40)
    pixels = keys.select(_tile_id(F.col("tile")).alias("tile_id"), "row", "col", value.cast("float").alias("elev"))
    n = keys.groupBy("tile").agg(F.max("row").alias("h"))
    gt = F.array(F.lit(_LON0) + _east(F.col("tile")), F.lit(_STEP), F.lit(0.0), F.lit(_LAT0) - _south(F.col("tile")), F.lit(0.0), F.lit(-_STEP))
    tiles = n.select("tile", _tile_id(F.col("tile")).alias("tile_id"), F.lit(_SIDE).alias("width"), (F.col("h") + 1).alias("height"), gt.alias("gt"), F.lit(-9999.0).alias("nodata"), F.lit(True).alias("has_nodata"))
    return cut(pixels), cut(tiles)


def on_tiles(rows: DataFrame, tiles: DataFrame, key: str) -> DataFrame:
    """Adds tile: runs of 101 keys go to the tiles in turn."""
    n = tiles.agg(F.coalesce(F.max("tile") + 1, F.lit(1)).alias("_n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("tile", F.pmod(F.floor(F.col(key) / 101), F.col("_n"))).drop("_n")


@query(f"with {_DEM} select count(*) as n_pixels, cast(min(elev) filter (where elev > -9000) as bigint) as min_elev, cast(max(elev) as bigint) as max_elev, count(*) filter (where elev < -9000) as n_void from dem")
def dem_statistics(spark, d):
    pixels, tiles = dem(spark, d)
    total = dem_stats(pixels, tiles).agg(F.sum("n_pixels").alias("n_pixels"), F.min("min_elev").alias("min_elev"), F.max("max_elev").alias("max_elev"), F.sum("n_void").alias("n_void"))
    return total.select("n_pixels", F.col("min_elev").cast("long").alias("min_elev"), F.col("max_elev").cast("long").alias("max_elev"), "n_void")


_SOUTH, _EASTWARD = f"(tile // {_ACROSS} * {_SIDE * _STEP!r}::double)", f"(tile % {_ACROSS} * {_SIDE * _STEP!r}::double)"
_SAMPLE = f"""with {_DEM}, h as (select tile, max(r) as h from dem group by tile), o as (select o_orderkey as id, o_orderkey // 101 % (select coalesce(max(tile) + 1, 1) from dem) as tile from orders),
pt as (select id, tile, (({_LAT0}::double - {_SOUTH} - (id * 37 % 1600) / 100000.0::double) - ({_LAT0}::double - {_SOUTH})) / -{_STEP}::double - 0.5 as row, (({_LON0}::double + {_EASTWARD} + (id * 53 % 1600) / 100000.0::double) - ({_LON0}::double + {_EASTWARD})) / {_STEP}::double - 0.5 as col from o),
q as (select id, tile, h, floor(row)::int as r0, floor(col)::int as c0, row - floor(row) as tr, col - floor(col) as tc from pt join h using (tile) where row between 0 and h and col between 0 and 49),
cor as (select id, tile, least(r0 + dr, h) as r, least(c0 + dc, 49) as c, case when dr = 1 then tr else 1 - tr end * case when dc = 1 then tc else 1 - tc end as w from q, (values (0, 0), (0, 1), (1, 0), (1, 1)) v(dr, dc)),
val as (select id, w, case when elev > -9000 then elev end as v from cor left join dem using (tile, r, c)),
s as (select id, coalesce(sum(w * v), 0) + coalesce(sum(case when v is null then w end), 0) * avg(v) as elev from val group by id)
select pt.id as point_id, cast(floor(coalesce(elev, -1) * 1000 + 0.5) as bigint) as elev_mm from pt left join s on s.id = pt.id"""


@query(_SAMPLE)
def sample_elevation(spark, d):
    pixels, tiles = dem(spark, d)
    k = F.col("o_orderkey")
    own = on_tiles(spark.read.parquet(f"{d}/orders.parquet"), tiles, "o_orderkey")
    points = own.select(k.alias("point_id"), _tile_id(F.col("tile")).alias("tile_id"), (F.lit(_LAT0) - _south(F.col("tile")) - (k * 37 % 1600) / 100000.0).alias("lat"), (F.lit(_LON0) + _east(F.col("tile")) + (k * 53 % 1600) / 100000.0).alias("lon"))
    return E.sample_elevation(points, pixels, tiles, default=-1.0).select("point_id", scaled(F.col("elev")).alias("elev_mm"))


def frame(tiles: DataFrame) -> DataFrame:
    """A terrain of the region's size on each tile."""
    a, b, c, e = lens.REGION
    north, east = (c - a) * geo.M_PER_DEGREE, (e - b) * geo.M_PER_DEGREE * math.cos(math.radians(a))
    corner = [(F.lit(a) - _south(F.col("tile"))).alias("lat0"), (F.lit(b) + _east(F.col("tile"))).alias("lon0")]
    box = [F.lit(v).alias(k) for k, v in (("min_x", 0.0), ("min_y", 0.0), ("max_x", north), ("max_y", east))]
    return E.terrain_frame(tiles.select(F.col("tile_id").alias("region_key"), "tile_id", *corner, *box), 50.0)


def flat_points(spark: SparkSession, d: str, tiles: DataFrame) -> DataFrame:
    """Nodes of the ways on each tile as points in metres about its terrain's corner. A node is a point on each tile that has one
    of its ways: point_id is the node's id, and a million more for each tile."""
    p = geo.to_local_m(F.col("lat"), F.col("lon"), F.lit(lens.REGION[0]), F.lit(lens.REGION[1]))
    used = on_tiles(lens.way_nodes(spark, d), tiles, "way_id").select("tile", F.col("node_id").alias("id")).distinct()
    own = used.join(lens.osm_nodes(spark, d), "id")
    return own.select((F.col("tile") * 1_000_000 + F.col("id")).alias("point_id"), _tile_id(F.col("tile")).alias("region_key"), p["x_north"].alias("x_m"), p["y_east"].alias("y_m"))


# --- the same in SQL: frames on tiles, grids sampled from pixels, heights on triangles, crossings of lines with triangles

_ORIGIN = (lens.REGION[0], lens.REGION[1])
_EAST_M = f"(111320.0::double * cos(radians({_ORIGIN[0]}::double)))"
_NORTH_LEN, _EAST_LEN = f"({lens.REGION[2]}::double - {lens.REGION[0]}::double) * 111320", f"({lens.REGION[3]}::double - {lens.REGION[1]}::double) * 111320 * cos(radians({lens.REGION[0]}::double))"
_FRAMES = f"""{_DEM}, high as (select tile, max(r) as h, min(elev) filter (where elev > -9000) as base from dem group by tile), n_tiles as (select coalesce(max(tile) + 1, 1) as n from dem),
boxes as (select tile, h, base, {_ORIGIN[0]}::double - {_SOUTH} as lat0, {_ORIGIN[1]}::double + {_EASTWARD} as lon0, {_LAT0}::double - {_SOUTH} as top, {_LON0}::double + {_EASTWARD} as left_lon from high)"""
_FIXED = f"bound as (select tile, 0.0::double as min_x, 0.0::double as min_y, {_NORTH_LEN} as max_x, {_EAST_LEN} as max_y from boxes)"


def _grid_sql(quad: float = 50.0) -> str:
    """fr and grid over boxes and bound: the header of each tile's grid, and its nodes with their heights."""
    div = lambda k: f"least(greatest(floor((max_{k} - min_{k}) / {quad} + 0.5), 16), 512)::int"
    return f"""fr as (select *, (max_x - min_x) / div_x as step_x, (max_y - min_y) / div_y as step_y from (select *, {div('x')} as div_x, {div('y')} as div_y from boxes join bound using (tile)) b),
gn as (select *, min_x + ix * step_x as x, min_y + iy * step_y as y from fr, range(513) a(ix), range(513) b(iy) where ix <= div_x and iy <= div_y),
gp as (select *, least(greatest(lat0 + x / 111320, top - (h + 1) * {_STEP}::double), top) as lat, least(greatest(lon0 + y / (111320.0::double * cos(radians(lat0))), left_lon), left_lon + 50 * {_STEP}::double) as lon from gn),
gq as (select *, floor(pr)::int as r0, floor(pc)::int as c0, pr - floor(pr) as tr, pc - floor(pc) as tc from (select *, (lat - top) / -{_STEP}::double - 0.5 as pr, (lon - left_lon) / {_STEP}::double - 0.5 as pc from gp) g where pr between 0 and h and pc between 0 and 49),
gc as (select tile, ix, iy, least(r0 + dr, h) as r, least(c0 + dc, 49) as c, case when dr = 1 then tr else 1 - tr end * case when dc = 1 then tc else 1 - tc end as w from gq, (values (0, 0), (0, 1), (1, 0), (1, 1)) v(dr, dc)),
gv as (select tile, ix, iy, coalesce(sum(w * v), 0) + coalesce(sum(case when v is null then w end), 0) * avg(v) as elev from (select gc.*, case when elev > -9000 then elev end as v from gc left join dem using (tile, r, c)) g group by tile, ix, iy),
grid as (select gn.tile, gn.ix, gn.iy, gn.x, gn.y, coalesce((gv.elev - gn.base) * 100, 0) as height from gn left join gv on gv.tile = gn.tile and gv.ix = gn.ix and gv.iy = gn.iy)"""


def _height_sql(points: str) -> str:
    """at: points (key, tile, x, y) with their height in cm."""
    local = lambda k: f"least(greatest(({k} - min_{k}) / step_{k}, 0), div_{k})"
    return f"""hp as (select key, tile, lx, ly, least(floor(lx)::int, div_x - 1) as cx, least(floor(ly)::int, div_y - 1) as cy from (select p.key, p.tile, div_x, div_y, {local('x')} as lx, {local('y')} as ly from {points} p join fr on fr.tile = p.tile) q),
hw as (select key, tile, cx + dx as ix, cy + dy as iy, case when fy >= fx then case when dx = 0 and dy = 0 then 1 - fy when dx = 0 then fy - fx when dy = 1 then fx else 0 end else case when dx = 0 and dy = 0 then 1 - fx when dx = 0 then 0 when dy = 1 then fy else fx - fy end end as w
  from (select *, lx - cx as fx, ly - cy as fy from hp) h, (values (0, 0), (0, 1), (1, 0), (1, 1)) v(dx, dy)),
lifted as (select key, sum(w * height) as height from hw join grid on grid.tile = hw.tile and grid.ix = hw.ix and grid.iy = hw.iy group by key)"""


def _crossings_sql(u: str, v: str, low: str, high: str) -> str:
    """Shares of a way from u to v at which it passes whole numbers within low and high."""
    whole = f"range(greatest(floor(least({u}, {v})) + 1, {low})::bigint, least(ceil(greatest({u}, {v})) - 1, {high})::bigint + 1)"
    return f"list_filter(list_transform({whole}, lambda k: (k - {u}) / nullif({v} - {u}, 0)), lambda t: t is not null and t > 0 and t < 1)"


# Sides of the ways of a kind in metres, on their tile, with the shares at which they cross grid lines and diagonals.
_SIDES = f"""sides as (select e.way_id, e.i, e.n, way_id // 101 % (select n from n_tiles) as tile, (ax - {_ORIGIN[0]}::double) * 111320 as x1, (ay - {_ORIGIN[1]}::double) * {_EAST_M} as y1, (bx - {_ORIGIN[0]}::double) * 111320 as x2, (by2 - {_ORIGIN[1]}::double) * {_EAST_M} as y2
  from ed e join node using (way_id) where node_type = KIND),
grids as (select s.*, (x1 - min_x) / step_x as u1, (x2 - min_x) / step_x as u2, (y1 - min_y) / step_y as v1, (y2 - min_y) / step_y as v2, div_x, div_y from sides s join fr using (tile)),
crossed as (select *, list_sort(list_concat(list_concat({_crossings_sql('u1', 'u2', '0', 'div_x')}, {_crossings_sql('v1', 'v2', '0', 'div_y')}), {_crossings_sql('(v1 - u1)', '(v2 - u2)', '-div_x', 'div_y')})) as ts from grids)"""
# Points of split lines in order: crossings nearer than a millimetre to the one before, or to the end, are merged.
_SPLIT = """gaps as (select *, case when sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) > 1e-8 then 0.001 / sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) else 1.0 end as gap from crossed where i < n),
kept as (select *, list_reduce(list_prepend([0.0::double], list_transform(ts, lambda t: [t])), lambda a, b: case when b[1] - a[len(a)] > gap and 1 - b[1] > gap then list_concat(a, b) else a end) as ks from gaps),
split as (select way_id, tile, i, k, x1 + (x2 - x1) * t as x, y1 + (y2 - y1) * t as y from (select *, unnest(ks) as t, unnest(range(len(ks))) as k from kept) u
  union all select way_id, tile, i + 1, 0, x2, y2 from crossed where i = n - 1)"""
# Points at which the ground under buildings may be highest or lowest: corners, crossings, and grid nodes inside.
_UNDER = f"""corners as (select way_id, tile, x1 + (x2 - x1) * t as x, y1 + (y2 - y1) * t as y from (select *, unnest(list_prepend(0.0::double, ts)) as t from crossed) c),
spans as (select way_id, tile, min(x1) as xa, max(x1) as xb, min(y1) as ya, max(y1) as yb from sides group by way_id, tile),
inner_nodes as (select s.way_id, s.tile, g.x, g.y from spans s join grid g on g.tile = s.tile and g.x between xa and xb and g.y between ya and yb join sides e on e.way_id = s.way_id
  group by s.way_id, s.tile, g.ix, g.iy, g.x, g.y having sum(case when (e.y1 > g.y) <> (e.y2 > g.y) and g.x < (e.x2 - e.x1) * (g.y - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 then 1 else 0 end) % 2 = 1),
places as (select way_id, row_number() over () as key, tile, x, y from (select way_id, tile, x, y from corners union all select way_id, tile, x, y from inner_nodes) p), {_height_sql('places')},
ground as (select way_id, min(coalesce(height, 0)) as low, max(coalesce(height, 0)) as high from places left join lifted using (key) group by way_id)"""
_UM = lambda x: f"cast(floor(({x}) * 1000 + 0.5) as bigint)"


@query(BASE + f", {_FRAMES}, {_FIXED}, {_grid_sql()}, used as (select distinct way_id // 101 % (select n from n_tiles) as tile, node_id from lens_way_nodes)," + f"""
place as (select tile * 1000000 + node_id as key, tile, (lat_u / 1e6 - {_ORIGIN[0]}::double) * 111320 as x, (lon_u / 1e6 - {_ORIGIN[1]}::double) * {_EAST_M} as y from used join lens_nodes using (node_id)), {_height_sql('place')}
select place.key as point_id, {_UM('coalesce(height, 0)')} as height_um from place left join lifted using (key)""")
def terrain_heights(spark, d):
    pixels, tiles = dem(spark, d)
    own = frame(tiles)
    grid = cut(E.terrain_grid(own, pixels, tiles))
    return E.terrain_height(flat_points(spark, d, tiles), own, grid).select("point_id", scaled(F.col("height_cm")).alias("height_um"))


def flat_rings(spark: SparkSession, d: str, kind: str) -> DataFrame:
    p = lambda q: geo.to_local_m(q["lat"], q["lon"], F.lit(lens.REGION[0]), F.lit(lens.REGION[1]))
    own = nodes(spark, d, [kind]).filter(F.col("node_type") == kind)
    flat = F.transform("points", lambda q: F.struct(p(q)["x_north"].alias("x"), p(q)["y_east"].alias("y")))
    return own.select(F.col("osm_id").alias("line_id"), F.col("osm_id").alias("node_id"), "region_key", "node_type", "subtype", F.col("metrics.width_m").alias("width_m"), F.col("metrics.height_m").alias("height_m"), "tags", F.explode(F.array(flat)).alias("points"))  # exploded from an array of one, so that it is made once


def tile_rings(spark: SparkSession, d: str, kind: str, tiles: DataFrame) -> DataFrame:
    return on_tiles(flat_rings(spark, d, kind), tiles, "line_id").withColumn("region_key", _tile_id(F.col("tile"))).drop("tile")


@query(BASE + f", {_FRAMES}, {_FIXED}, {_grid_sql()}, " + _SIDES.replace("KIND", "'Building'") + f", {_UNDER} select way_id as line_id, {_UM('low')} as min_um, {_UM('high')} as max_um from ground")
def ground_ranges(spark, d):
    pixels, tiles = dem(spark, d)
    own = frame(tiles)
    grid = cut(E.terrain_grid(own, pixels, tiles))
    return E.ground_range(cut(tile_rings(spark, d, "Building", tiles).select("line_id", "region_key", "points")), own, grid).select("line_id", scaled(F.col("min_cm")).alias("min_um"), scaled(F.col("max_cm")).alias("max_um"))


@query(BASE + f", {_FRAMES}, {_FIXED}, {_grid_sql()}, " + _SIDES.replace("KIND", "'RoadSegment'") + f", {_SPLIT} select way_id as line_id, count(*) as points, sum(cast(floor(x * 1000 + 0.5) as bigint))::bigint as x_mm, sum(cast(floor(y * 1000 + 0.5) as bigint))::bigint as y_mm from split group by way_id")
def split_roads(spark, d):
    """Roads cut where they cross the terrain's triangles."""
    pixels, tiles = dem(spark, d)
    lines = cut(tile_rings(spark, d, "RoadSegment", tiles).filter(F.size("points") > 1).select("line_id", "region_key", "points", F.lit(False).alias("closed")))
    own = E.split_at_triangles(lines, frame(tiles))
    return own.groupBy("line_id").agg(F.count("*").alias("points"), F.sum(scaled(F.col("x_m"))).alias("x_mm"), F.sum(scaled(F.col("y_m"))).alias("y_mm"))


def grown_frame(spark: SparkSession, d: str, tiles: DataFrame, rings: DataFrame) -> DataFrame:
    """A terrain on each tile under its region and all buildings on it, 20 m wider than both."""
    points = rings.select("region_key", F.explode("points").alias("p")).select("region_key", F.col("p.x").alias("x_m"), F.col("p.y").alias("y_m"))
    a, b, c, e = lens.REGION
    box = [F.lit(v).alias(k) for k, v in (("min_x", 0.0), ("min_y", 0.0), ("max_x", (c - a) * geo.M_PER_DEGREE), ("max_y", (e - b) * geo.M_PER_DEGREE * math.cos(math.radians(a))))]
    corner = [(F.lit(a) - _south(F.col("tile"))).alias("lat0"), (F.lit(b) + _east(F.col("tile"))).alias("lon0")]
    return E.terrain_frame(E.ground_bounds(points, tiles.select(F.col("tile_id").alias("region_key"), "tile_id", *corner, *box)), 50.0)


_GROWN = f"""reach as (select tile, min(x1) as xa, max(x1) as xb, min(y1) as ya, max(y1) as yb from (select way_id // 101 % (select n from n_tiles) as tile, (ax - {_ORIGIN[0]}::double) * 111320 as x1, (ay - {_ORIGIN[1]}::double) * {_EAST_M} as y1 from ed join node using (way_id) where node_type = 'Building') e group by tile),
bound as (select tile, least(0.0::double, xa) - 20 as min_x, least(0.0::double, ya) - 20 as min_y, greatest({_NORTH_LEN}, xb) + 20 as max_x, greatest({_EAST_LEN}, yb) + 20 as max_y from boxes left join reach using (tile))"""


@query(BASE + f", {_FRAMES}, {_GROWN} select 't' || tile as region_key, {MM('min_x')} as min_x_mm, {MM('min_y')} as min_y_mm, {MM('max_x')} as max_x_mm, {MM('max_y')} as max_y_mm from bound")
def ground_boxes(spark, d):
    _, tiles = dem(spark, d)
    own = grown_frame(spark, d, tiles, tile_rings(spark, d, "Building", tiles))
    return own.select("region_key", *[scaled(F.col(c)).alias(f"{c}_mm") for c in ("min_x", "min_y", "max_x", "max_y")])


_HOUSE_HEIGHT = """case when t > 0 then t when l > 0 then l * 3 else case when value in ('house','detached') then 8 when value = 'apartments' then 18
 when value = 'office' then 30 when value = 'commercial' then 15 when value in ('garage','shed') then 3.5 else 9 end end"""


@query(BASE + f", {_FRAMES}, {_GROWN}, {_grid_sql()}, " + _SIDES.replace("KIND", "'Building'") + f""", {_UNDER},
tall as (select way_id, value, case height when '12.5 m' then 12.5 else 0 end as t, case levels when '4' then 4 when '6 floors' then 6 else 0 end as l from node where node_type = 'Building')
select way_id as node_id, {_UM('low - 50')} as base_um, {_UM(f"{_HOUSE_HEIGHT} + (high - low + 50) / 100")} as height_mm from ground join tall using (way_id)""")
def seated_buildings(spark, d):
    """Buildings on the ground of grids that follow from region and buildings: bounds, frame, grid, ranges and seats in one plan."""
    pixels, tiles = dem(spark, d)
    rings = cut(tile_rings(spark, d, "Building", tiles))
    own = cut(grown_frame(spark, d, tiles, rings))
    grid = cut(E.terrain_grid(own, pixels, tiles))
    ranges = E.ground_range(rings.select("line_id", "region_key", "points"), own, grid).withColumnRenamed("line_id", "node_id")
    seated = M.seat_buildings(rings.select("node_id", "height_m"), ranges)
    return seated.select("node_id", scaled(F.col("base_cm")).alias("base_um"), scaled(F.col("height_m")).alias("height_mm"))


@query(BASE + f", {_FRAMES}, {_FIXED}, {_grid_sql()}, " + _SIDES.replace("KIND", "'RoadSegment'") + f""", {_SPLIT},
width as (select way_id, case when width is not null then 7.5 else case value when 'motorway' then 14 when 'trunk' then 12 when 'primary' then 10 when 'secondary' then 8 when 'tertiary' then 7 when 'service' then 4 when 'footway' then 2 when 'path' then 2 else 6 end end / 2.0 as half from node where kind = 2),
step as (select *, row_number() over w - 1 as nr, coalesce(x - lag(x) over w, 0) as px, coalesce(y - lag(y) over w, 0) as py, coalesce(lead(x) over w - x, 0) as nx, coalesce(lead(y) over w - y, 0) as ny from split window w as (partition by way_id order by i, k)),
norm as (select *, sqrt(px * px + py * py) as pl, sqrt(nx * nx + ny * ny) as nl from step),
way as (select *, case when pl > 1e-8 then px / pl else 0 end + case when nl > 1e-8 then nx / nl else 0 end as sx, case when pl > 1e-8 then py / pl else 0 end + case when nl > 1e-8 then ny / nl else 0 end as sy from norm),
dir as (select *, case when sqrt(sx * sx + sy * sy) > 1e-8 then sx / sqrt(sx * sx + sy * sy) else 0 end as dx, case when sqrt(sx * sx + sy * sy) > 1e-8 then sy / sqrt(sx * sx + sy * sy) else 0 end as dy from way),
edge as (select way_id, nr, tile, side, row_number() over () as key, x - s * dy * half as x, y + s * dx * half as y from dir join width using (way_id), (values ('left', 1), ('right', -1)) v(side, s)), {_height_sql('edge')}
select way_id as line_id, nr::int as n, side, cast(floor(x * 1000 + 0.5) as bigint) as x_mm, cast(floor(y * 1000 + 0.5) as bigint) as y_mm, {_UM('coalesce(height, 0) + 35')} as z_um from edge left join lifted using (key)""")
def road_ribbons(spark, d):
    pixels, tiles = dem(spark, d)
    own = frame(tiles)
    grid = cut(E.terrain_grid(own, pixels, tiles))
    out = M.linear_ribbons(cut(tile_rings(spark, d, "RoadSegment", tiles).drop("tags")), own, grid)
    return out.select("line_id", "n", "side", scaled(F.col("x_m")).alias("x_mm"), scaled(F.col("y_m")).alias("y_mm"), scaled(F.col("z_cm")).alias("z_um"))


@query(f"with {_DEM} select 't' || tile as tile_id, true as aligned from dem where elev > -9000 group by tile")
def dem_alignment(spark, d):
    """Pixel centres that come back from the local frame to within a ten-thousandth of a second of arc."""
    pixels, tiles = dem(spark, d)
    own = E.dem_alignment_error(pixels.filter("elev > -9000"), tiles, MID, 77.607, 900.0)
    return own.select("tile_id", (F.col("arc_seconds") < 1e-4).alias("aligned"))


_TRIANGLES = """cell as (select a.tile, 100 * fr.step_x as sx, 100 * fr.step_y as sy, a.height as ha, b.height as hb, c.height as hc, d.height as hd from grid a join fr on fr.tile = a.tile
  join grid b on b.tile = a.tile and b.ix = a.ix and b.iy = a.iy + 1 join grid c on c.tile = a.tile and c.ix = a.ix + 1 and c.iy = a.iy + 1 join grid d on d.tile = a.tile and d.ix = a.ix + 1 and d.iy = a.iy),
tri as (select tile, -sx * sy as nz, sx * (hb - ha) as p, sy * (hc - hb) as q from cell union all select tile, -sx * sy, sx * (hc - hd), sy * (hd - ha) from cell)"""


@query(f"with {_FRAMES}, {_FIXED}, {_grid_sql()}, {_TRIANGLES}, v as (select tile, count(*) as vertices from grid group by tile) select 't' || tile as mesh_id, any_value(vertices) as vertices, count(*) as triangles, 0::bigint as up, count(*) filter (where nz / sqrt(nz * nz + p * p + q * q) < -0.7) as down, cast(floor(sum(sqrt(nz * nz + p * p + q * q)) / 2 / 10000 + 0.5) as bigint) as area_m2 from tri join v using (tile) group by tile")
def terrain_sheets(spark, d):
    """The terrain of each tile as a mesh: its size, which way its triangles face, and its surface."""
    pixels, tiles = dem(spark, d)
    own = frame(tiles)
    vertices, triangles = (cut(t.withColumnRenamed("region_key", "mesh_id")) for t in E.terrain_mesh(own, cut(E.terrain_grid(own, pixels, tiles))))
    count = lambda t, name: t.groupBy("mesh_id").agg(F.count("*").alias(name))
    found = count(vertices, "vertices").join(count(triangles, "triangles"), "mesh_id").join(M.mesh_normals(vertices, triangles), "mesh_id").join(M.mesh_area(vertices, triangles), "mesh_id")
    return found.select("mesh_id", "vertices", "triangles", "up", "down", scaled(F.col("area_m2"), 1).alias("area_m2"))


@query(BASE + f"""select way_id as osm_id, {MM("(case when t > 0 then t when l > 0 then greatest(l * 3.2, 3.2) else 9.6 end)")} as height_mm from (
 select way_id, case height when '12.5 m' then 12.5 else 0 end as t, case levels when '4' then 4 when '6 floors' then 6 else 0 end as l from typed where kind < 2) x""")
def archetype_heights(spark, d):
    own = lens.way_tags(spark, d).filter("tags['building'] is not null or tags['building:part'] is not null")
    h = leading_number(F.coalesce(F.col("tags")["height"], F.lit("")))
    levels = leading_integer(F.coalesce(F.col("tags")["building:levels"], F.lit("")))
    return own.select(F.col("way_id").alias("osm_id"), scaled(M.archetype_height(h, levels, F.col("way_id"))).alias("height_mm"))


@query(f"with {_PROPS}, w as (select distinct user_id as node_id, event_id % 3 as section from events), z as (select distinct user_id as node_id, s.section, user_id % 15 + 1 as code from events, (values (0), (1)) s(section)) select w.node_id, w.section, cast(floor(coalesce(base_temp_k, 293.15) * 100 + 0.5) as bigint) as temp_ck from w left join z on z.node_id = w.node_id and z.section = w.section left join props p on p.code = z.code")
def zone_temp(spark, d):
    """The temperature of each section that events ask for; every third has none."""
    events = spark.read.parquet(f"{d}/events.parquet")
    own = zones(spark, d).withColumnRenamed("zone_id", "node_id").withColumn("section", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    wanted = events.select(F.col("user_id").alias("node_id"), (F.col("event_id") % 3).cast("long").alias("section")).distinct()
    return H.zone_temp(own, wanted).select("node_id", "section", scaled(F.col("temp_k"), 100).alias("temp_ck"))


# --- footprints and walls

@query(BASE + f""", area as (select way_id, area_m2 * cos(radians(12.97)) / cos(radians({MID})) as a from node where kind < 2) select way_id as node_id, cast(floor(a * 100 + 0.5) as bigint) as area_dm2 from area where a >= 0.5""")
def footprints(spark, d):
    good, _ = M.normalise_footprint(flat_rings(spark, d, "Building").select("node_id", "points"))
    return good.select("node_id", scaled(F.col("area_m2"), 100).alias("area_dm2"))


@query(BASE + f""", side as (select e.way_id, e.i, sqrt(power((bx - ax) * 111320, 2) + power((by2 - ay) * 111320.0 * cos(radians(12.97)), 2)) as len from ed e join node using (way_id) where node.kind < 2 and area_m2 * cos(radians(12.97)) / cos(radians({MID})) >= 0.5)
select way_id as node_id, sum(greatest(floor(len / 3 + 0.5), 1))::bigint as bays, sum({MM('len')})::bigint as wall_mm from side where len >= 0.05 group by way_id""")
def facades(spark, d):
    good, _ = M.normalise_footprint(flat_rings(spark, d, "Building").select("node_id", "points"))
    bays = M.facade_bays(good)
    return bays.groupBy("node_id").agg(F.count("*").alias("bays"), F.sum(F.when(F.col("bay") == 0, scaled(F.col("length_m")))).alias("wall_mm"))


@query(BASE + "select way_id as osm_id, node_type as layer, case node_type when 'LanduseZone' then 5 when 'VegetationArea' then 10 when 'LeisureArea' then 15 when 'Amenity' then 20 else 25 end as lift_cm from node where closed and (node_type in ('LanduseZone', 'VegetationArea', 'LeisureArea', 'WaterBody') or (node_type = 'Amenity' and value = 'parking'))")
def area_layers(spark, d):
    return M.area_layers(listed(spark, d, list(M.LAYERS))).select("osm_id", "layer", F.col("lift_cm").cast("int").alias("lift_cm"))


# --- coordinates


@query("select c_custkey as id, cast(floor(n * cos(phi) * cos(lam) * 1000 + 0.5) as bigint) as x_mm, cast(floor(n * cos(phi) * sin(lam) * 1000 + 0.5) as bigint) as y_mm, cast(floor(n * (1 - e2) * sin(phi) * 1000 + 0.5) as bigint) as z_mm from (select *, 6378137.0::double / sqrt(1 - e2 * sin(phi) * sin(phi)) as n from (select c_custkey, radians((c_custkey * 37 % 17000) / 100.0::double - 85) as phi, radians((c_custkey * 53 % 35000) / 100.0::double - 175) as lam, (1 / 298.257223563::double) * (2 - 1 / 298.257223563::double) as e2 from customer) a) b")
def ecef(spark, d):
    k = F.col("c_custkey").cast("long")
    p = geo.to_ecef((k * 37 % 17000) / 100 - 85, (k * 53 % 35000) / 100 - 175, F.lit(0.0))
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), p.alias("p")).select("id", scaled(F.col("p.x")).alias("x_mm"), scaled(F.col("p.y")).alias("y_mm"), scaled(F.col("p.z")).alias("z_mm"))


@query("""with k as (select cast(c_custkey as bigint) as id, 12.97::double + (c_custkey % 100) / 10000.0::double as lat, 77.602::double + (c_custkey % 97) / 10000.0::double as lon, 910.0::double as h, 12.975::double as lat0, 77.607::double as lon0, 900.0::double as h0 from customer),
    e as (select *, (1 / 298.257223563::double) * (2 - 1 / 298.257223563::double) as e2, sin(radians(lat0)) as s, cos(radians(lat0)) as c, sin(radians(lon0)) as sl, cos(radians(lon0)) as cl from k),
    n as (select *, 6378137.0::double / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat))) as n, 6378137.0::double / sqrt(1 - e2 * s * s) as n0 from e),
    d as (select *, (n + h) * cos(radians(lat)) * cos(radians(lon)) - (n0 + h0) * c * cl as dx, (n + h) * cos(radians(lat)) * sin(radians(lon)) - (n0 + h0) * c * sl as dy, (n * (1 - e2) + h) * sin(radians(lat)) - (n0 * (1 - e2) + h0) * s as dz from n)
    select id, cast(floor(((cl * dy - sl * dx) * 100)::float::double + 0.5) as bigint) as east_cm, cast(floor(((c * dz - s * cl * dx - s * sl * dy) * 100)::float::double + 0.5) as bigint) as north_cm, cast(floor(((c * cl * dx + c * sl * dy + s * dz) * 100)::float::double + 0.5) as bigint) as up_cm,
    cast(floor(lat * 1e7 + 0.5) as bigint) as lat_e7, cast(floor(lon * 1e7 + 0.5) as bigint) as lon_e7, cast(floor(h * 100 + 0.5) as bigint) as height_cm from d""")
def enu_round_trip(spark, d):
    k = F.col("c_custkey").cast("long")
    lat0, lon0, h0 = F.lit(12.975), F.lit(77.607), F.lit(900.0)
    lat, lon = F.lit(12.97) + (k % 100) / 10000, F.lit(77.602) + (k % 97) / 10000
    own = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"))
    own = own.withColumn("e", geo.to_enu_cm(F.col("lat"), F.col("lon"), F.lit(910.0), lat0, lon0, h0)).withColumn("b", geo.from_enu_cm(F.col("e"), lat0, lon0, h0))
    frame = [scaled(F.col(f"e.{n}").cast("double"), 1).alias(f"{n}_cm") for n in ("east", "north", "up")]
    back = [scaled(F.col(f"b.{n}"), by).alias(name) for n, by, name in (("lat", 1e7, "lat_e7"), ("lon", 1e7, "lon_e7"), ("height", 100, "height_cm"))]
    return own.select("id", *frame, *back)


@query("select id, cast(g[r + 1][c % 36 + 1] as bigint) as separation from (select cast(c_custkey as bigint) as id, (c_custkey % 18)::int as r, (c_custkey % 36)::int as c, [" + ", ".join(str(row) for row in geo.GEOID_ROWS) + "] as g from customer) x")
def geoid_nodes(spark, d):
    k = F.col("c_custkey").cast("long")
    own = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"))
    return own.select("id", geo.geoid_separation(90.0 - (F.col("id") % 18) * 10.0, (F.col("id") % 36) * 10.0 - 180.0).cast("long").alias("separation"))
