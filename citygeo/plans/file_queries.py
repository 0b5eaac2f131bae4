"""Queries that write the driver's tables as files to the shared checkpoint folder and read them back, and the SQL that states the same."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.functions.numbers import scaled
from citygeo.operators import features as C
from citygeo.operators import quality as V
from citygeo.operators.cut import checkpoint_folder
from citygeo.plans import map_queries, world_queries
from citygeo.plans.map_queries import BASE
from citygeo.sources import dem, lens, osm_xml, store

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def map_folder(spark: SparkSession, d: str) -> str:
    folder = new_folder(spark, "map")
    osm_xml.write_osm_xml(lens.osm_nodes(spark, d), lens.way_nodes(spark, d), lens.way_tags(spark, d), folder)
    return folder


@query(map_queries.ORACLES["resolve_ways"])
def map_files(spark, d):
    """All ways of the lens by way of map files: written, read as XML, and resolved."""
    nodes, ways, _ = osm_xml.read_osm_xml(spark, f"{map_folder(spark, d)}/*")
    own = C.resolve_ways(osm_xml.way_nodes(ways), nodes)
    total = lambda k: F.aggregate(F.transform("points", lambda p, i: scaled(p[k], 1_000_000) * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return own.select("way_id", "n_refs", "n_missing", "closed", total("lat").alias("lat_sum"), total("lon").alias("lon_sum"))


@query(BASE + "select way_id, feature_type, value as subtype, coalesce(name, '') as name from typed where way_id in (select way_id from lens_way_nodes)")
def map_file_tags(spark, d):
    _, ways, _ = osm_xml.read_osm_xml(spark, f"{map_folder(spark, d)}/ways")
    return ways.select(F.col("id").alias("way_id"), C.classify(F.col("tags")).alias("c"), F.coalesce(F.col("tags")["name"], F.lit("")).alias("name")).select("way_id", "c.feature_type", "c.subtype", "name")


_CUTS = [("a", 12.97, 77.602, 12.975, 77.607), ("b", 12.972, 77.605, 12.979, 77.611), ("c", 12.9745, 77.6, 12.9755, 77.615)]
_CUT_SQL = BASE + ", regs(region_key, a, b, c, d) as (values " + ", ".join(f"('{k}', {', '.join(str(round(v * 1e6)) for v in box)})" for k, *box in _CUTS) + """),
mem0 as (select way_id // 60 as rel, way_id from lens_way where kind in (4, 7, 8, 9)),
inside as (select region_key, node_id from lens_nodes, regs where lat_u between a and c and lon_u between b and d),
touch as (select distinct region_key, way_id from inside join lens_way_nodes using (node_id)),
rels as (select distinct region_key, rel from touch join mem0 using (way_id) where rel % 3 <> 0),
ways as (select region_key, way_id from touch union select region_key, way_id from rels join mem0 using (rel)),
near as (select distinct region_key, node_id from ways join lens_way_nodes using (way_id) join lens_nodes using (node_id) join regs using (region_key) where lat_u between a - 1000 and c + 1000 and lon_u between b - 1000 and d + 1000),
every as (select * from inside union select * from near)"""


@query(_CUT_SQL + """ select region_key, 'nodes' as kind, count(*) as n, sum(node_id)::bigint as ids from every group by region_key union all select region_key, 'ways', count(*), sum(way_id)::bigint from ways group by region_key
union all select region_key, 'relations', count(*), sum(rel)::bigint from rels group by region_key""")
def extract_regions(spark, d):
    """Three regions that overlap, cut out of the lens at once; every sixty ways have a relation, two in three of them multipolygons."""
    ways = lens.way_nodes(spark, d).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("r")).join(lens.view(spark, d, "lens_way").select("way_id", "kind"), "way_id")
    own = lens.view(spark, d, "lens_way").filter("kind in (4, 7, 8, 9)").select(F.floor(F.col("way_id") / 60).alias("id"), F.struct(F.lit("way").alias("type"), F.col("way_id").alias("ref"), F.lit("outer").alias("role")).alias("m"))
    relations = own.groupBy("id").agg(F.collect_list("m").alias("members")).withColumn("tags", F.create_map(F.lit("type"), F.when(F.col("id") % 3 == 0, "route").otherwise("multipolygon")))
    edge = 1e-9  # borders lie on nodes
    regions = spark.createDataFrame([(k, a - edge, b - edge, c + edge, e + edge) for k, a, b, c, e in _CUTS], lens.regions(spark).schema)
    parts = osm_xml.extract_region(lens.osm_nodes(spark, d), ways.select(F.col("way_id").alias("id"), F.col("r.node_id").alias("refs")), relations, regions)
    total = lambda df, kind: df.groupBy("region_key").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("id").alias("ids"))
    return total(parts[0], "nodes").unionByName(total(parts[1], "ways")).unionByName(total(parts[2], "relations"))


_FAULTS = ["sound", "cut", "web", "tiny", "bare"]


@query("""with o as (select o_orderkey % 5 as k, count(*) as n from orders group by 1) select case k when 1 then 'cut' when 2 then 'web' when 3 then 'tiny' end as file, case k when 2 then 'osm.root.missing' else 'osm.file.truncated' end as code
 from o where k in (1, 2, 3) union all select 'gone', 'osm.file.missing' union all select 'bare', 'osm.root.missing' from o where k = 4""")
def map_file_issues(spark, d):
    """Orders as map files of five kinds, of which one is sound: without an end, a web page, under 64 bytes, and without a root."""
    folder = new_folder(spark, "faults")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.element_at(F.array(*map(F.lit, _FAULTS)), (F.col("o_orderkey") % 5).cast("int") + 1).alias("kind"))
    one = F.format_string('<node id="%d" lat="1.0" lon="2.0"/>', "o_orderkey")
    body = orders.filter("kind <> 'tiny'").groupBy("kind").agg(F.array_join(F.slice(F.sort_array(F.collect_list(one)), 1, 20), "\n").alias("body"))
    tiny = orders.filter("kind = 'tiny'").select("kind", F.lit("").alias("body")).distinct()
    k = F.col("kind")
    head = F.when(k == "web", "<html>").when(k == "bare", "").otherwise("<osm>")
    tail = F.when(k == "cut", "").when(k == "web", "</html>").otherwise("</osm>")
    body.unionByName(tiny).select("kind", F.concat(head, F.lit("\n"), "body", F.lit("\n"), tail).alias("value")).repartition("kind").write.partitionBy("kind").text(folder)
    issues = V.osm_file_issues(spark, [f"{folder}/kind={kind}" for kind in [*_FAULTS, "gone"]])
    return issues.select(F.regexp_extract("scope", "kind=([a-z]+)", 1).alias("file"), "code")


def write_rasters(pixels: DataFrame, tiles: DataFrame, folder: str) -> DataFrame:
    """Each tile as a TIFF file, every second one packed: (path). A tile is a raster of 2,500 pixels at most here."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for tile_id, width, height, gt, nodata, at in zip(f["tile_id"], f["width"], f["height"], f["gt"], f["nodata"], f["at"]):
                grid = np.full((height, width), nodata, np.float32)
                for p in at:
                    grid[p["row"], p["col"]] = p["elev"]
                local = folder.split(":", 1)[0] == "file"
                fs, path = (arrow_fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")) if local else arrow_fs.FileSystem.from_uri(folder)
                fs.create_dir(path)
                with fs.open_output_stream(f"{path}/{tile_id}") as out:
                    out.write(dem.tiff_bytes(grid, list(gt), nodata, deflate=int(tile_id[1:]) % 2 == 1))
                yield pd.DataFrame({"path": [f"{folder}/{tile_id}"]})

    own = pixels.groupBy("tile_id").agg(F.collect_list(F.struct("row", "col", "elev")).alias("at")).join(tiles, "tile_id")
    return own.select("tile_id", "width", "height", "gt", "nodata", "at").mapInPandas(write, "path string")


def raster_folder(spark: SparkSession, d: str) -> str:
    folder = new_folder(spark, "rasters")
    pixels, tiles = world_queries.dem(spark, d)
    write_rasters(pixels, tiles, folder).write.format("noop").mode("overwrite").save()
    return folder


_RASTER = f"""with {world_queries._DEM} select 't' || tile as tile_id, 50::int as width, (max(r) + 1)::int as height, (max(r) + 1) * 50 as pixels, (max(r) + 1) * 50 - count(*) filter (where elev > -9000) as voids, sum(case when elev > -9000 then elev * (r * 50 + c) else 0 end)::bigint as weighted,
 cast(floor(({world_queries._LAT0}::double - {world_queries._SOUTH}) * 1e6 + 0.5) as bigint) as north_u, cast(floor(({world_queries._LON0}::double + {world_queries._EASTWARD}) * 1e6 + 0.5) as bigint) as west_u from dem group by tile"""


@query(_RASTER)
def raster_files(spark, d):
    """All rasters by way of TIFF files, plain and packed: headers and pixels as they are read back."""
    headers, pixels = dem.read_dem(spark, raster_folder(spark, d))
    void = F.col("elev") < -9000
    own = pixels.groupBy("tile_id").agg(F.count("*").alias("pixels"), F.count_if(void).alias("voids"), F.sum(F.when(~void, F.col("elev").cast("long") * (F.col("row") * 50 + F.col("col"))).otherwise(0)).alias("weighted"))
    return headers.filter("error is null").join(own, "tile_id").select("tile_id", "width", "height", "pixels", "voids", "weighted", scaled(F.col("gt")[3], 1_000_000).alias("north_u"), scaled(F.col("gt")[0], 1_000_000).alias("west_u"))


@query(f"with {world_queries._DEM} select r::int as row, c::int as col, elev::bigint as elev from dem where tile = 0 and r between 3 and 6 and elev > -9000")
def raster_rows(spark, d):
    """Some rows of one raster: other files and rows are not read."""
    _, pixels = dem.read_dem(spark, raster_folder(spark, d))
    return pixels.filter("tile_id = 't0' and row >= 3 and row < 7 and elev > -9000").select("row", "col", F.col("elev").cast("long").alias("elev"))


@query(f"with {world_queries._DEM}, h as (select tile, max(r) + 1 as h from dem group by tile) select 't' || tile as scope, 'tif.pixelscale.implausible' as code from h where tile % 3 = 0")
def raster_header_issues(spark, d):
    """Headers as read back, every third in metres."""
    folder = new_folder(spark, "rasters")
    pixels, tiles = world_queries.dem(spark, d)
    metres = F.transform("gt", lambda v, i: F.when(i.isin(1, 5), v * 100_000).otherwise(v))
    tiles = tiles.withColumn("gt", F.when(F.col("tile") % 3 == 0, metres).otherwise(F.col("gt")))
    write_rasters(pixels, tiles, folder).write.format("noop").mode("overwrite").save()
    return V.dem_header_issues(dem.read_dem(spark, folder)[0]).select("scope", "code")


@query(BASE + "select node_type, count(*) as nodes, sum(n_pts)::bigint as points from node group by node_type")
def stored_graph(spark, d):
    """Nodes by way of a graph on disk, two regions written one after the other."""
    folder = new_folder(spark, "graph")
    own = map_queries.nodes(spark, d)
    for part in (0, 1):
        store.write_graph({"nodes": own.filter(F.col("osm_id") % 2 == part).withColumn("region_key", F.lit(f"half {part}"))}, folder)
    return store.read_graph(spark, folder, ["nodes"])["nodes"].groupBy("node_type").agg(F.count("*").alias("nodes"), F.sum(F.size("points")).alias("points"))


@query(BASE + "select node_type as kind, count(*) as meshes, sum(n_pts * 2)::bigint as numbers, sum(u)::bigint as total_u from node join (select way_id, sum(lat_u + lon_u) as u from pts group by way_id) using (way_id) group by node_type")
def mesh_dump(spark, d):
    """Outlines of all nodes by way of a mesh dump."""
    folder = new_folder(spark, "dump")
    own = map_queries.nodes(spark, d)
    flat = F.flatten(F.transform("points", lambda p: F.array(F.floor(p["lat"] * 1e6 + 0.5).cast("double"), F.floor(p["lon"] * 1e6 + 0.5).cast("double"))))
    store.write_mesh_dump(own.select(F.col("node_type").alias("kind"), F.col("name").alias("label"), F.array(*[F.lit(0.0)] * 3).alias("loc"), flat.alias("v"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("t")), folder)
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return store.read_mesh_dump(spark, folder).groupBy("kind").agg(F.count("*").alias("meshes"), F.sum(F.size("v")).alias("numbers"), F.sum(total).alias("total_u"))


@query("""select c_custkey::bigint as request_id, c_custkey % 6 <> 0 and c_custkey % 4 <> 1 and c_custkey % 5 <> 2 and c_custkey % 7 <> 3 and c_custkey % 9 <> 4 as reusable from customer""")
def cache_decisions(spark, d):
    """A fetch for each customer against manifests written before: some are missing, of another version, raster or padding, or with a file cut short."""
    folder = new_folder(spark, "manifests")
    k = F.col("c_custkey").cast("long")
    own = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("request_id"))
    i = F.col("request_id")
    box = [(F.lit(10.0) + i / 1000).alias("min_lat"), F.lit(20.0).alias("min_lon"), (F.lit(10.01) + i / 1000).alias("max_lat"), F.lit(20.01).alias("max_lon")]
    requests = own.select("request_id", *box, F.lit("SRTM").alias("dem_type"), F.lit(0.001).alias("padding_deg"))
    written = requests.filter(i % 6 != 0).select(
        F.when(i % 4 == 1, 2).otherwise(1).alias("version"), F.when(i % 5 == 2, "COP").otherwise("SRTM").alias("demType"), F.when(i % 7 == 3, 0.002).otherwise(0.001).alias("demPaddingDegrees"), F.lit(100.0).alias("osmFileSize"), F.lit(200.0).alias("demFileSize"),
        F.col("min_lat").alias("minLat"), F.col("min_lon").alias("minLon"), F.col("max_lat").alias("maxLat"), F.col("max_lon").alias("maxLon"),
    )
    written.select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    manifests = spark.read.schema(", ".join(f"{n} {'string' if kind.endswith('string') else 'double'}" for n, kind in store.MANIFEST.items())).json(folder)
    manifests = manifests.select(*[F.col(n).cast(kind.split()[1]).alias(kind.split()[0]) for n, kind in store.MANIFEST.items()])
    files = requests.select(store.cache_key().alias("cache_key"), F.lit(100).cast("long").alias("osm_length"), F.when(i % 9 == 4, 150).otherwise(200).cast("long").alias("dem_length"))
    return store.cache_reusable(requests, manifests, files)
