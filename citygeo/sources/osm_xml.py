"""Map files in XML: nodes, ways and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citygeo.operators.region import points_in_region, region_expand

_TAG = "tag array<struct<_k: string, _v: string>>"
SCHEMAS = {
    "node": f"_id long, _lat double, _lon double, {_TAG}",
    "way": f"_id long, nd array<struct<_ref: long>>, {_TAG}",
    "relation": f"_id long, member array<struct<_type: string, _ref: long, _role: string>>, {_TAG}",
}


def _tags() -> Column:
    """The last value of a repeated key wins; a null key is dropped."""
    items = F.filter(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")), lambda t: t["_k"].isNotNull())
    last = F.filter(items, lambda t, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda u: u["_k"] == t["_k"]))
    return F.map_from_entries(F.transform(last, lambda t: F.struct(t["_k"], t["_v"]))).alias("tags")


def _last(df: DataFrame) -> DataFrame:
    """One row an id: of rows with equal ids the one that stands last, by file and place."""
    order = Window.partitionBy("id").orderBy(F.desc("_file"), F.desc("_place"))
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_file", "_place")


def read_osm_xml(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(id, lat, lon, tags), ways(id, refs, closed, tags), relations(id, members, tags).

    Schemas are given, so files are read once for each frame and never to infer them. Large files are split by rows.
    """
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(SCHEMAS[tag]).load(paths).select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_place")).filter("_id is not null")
    nodes = read("node").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags(), "_file", "_place")
    refs = F.transform(F.coalesce("nd", F.array().cast("array<struct<_ref: long>>")), lambda n: n["_ref"])
    ways = read("way").select(F.col("_id").alias("id"), refs.alias("refs"), _tags(), "_file", "_place")
    ways = ways.withColumn("closed", (F.size("refs") >= 2) & (F.col("refs")[0] == F.try_element_at("refs", F.lit(-1))))
    members = F.transform(F.coalesce("member", F.array().cast("array<struct<_type: string, _ref: long, _role: string>>")), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    relations = read("relation").select(F.col("_id").alias("id"), members.alias("members"), _tags(), "_file", "_place")
    return _last(nodes), _last(ways).select("id", "refs", "closed", "tags"), _last(relations)


def write_osm_xml(nodes: DataFrame, way_nodes: DataFrame, tags: DataFrame, path: str) -> None:
    """nodes(id, lat, lon, tags), way_nodes(way_id, seq, node_id) and tags(way_id, tags) as map files under path/nodes and path/ways; each
    part is a whole file."""
    listed = lambda c: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v"))).alias("tag")
    save = lambda df, row, folder: df.write.format("xml").mode("overwrite").option("rootTag", "osm").option("rowTag", row).option("declaration", 'version="1.0" encoding="UTF-8"').save(f"{path}/{folder}")
    save(nodes.select(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), listed("tags")), "node", "nodes")
    refs = way_nodes.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("refs"))
    nd = F.transform("refs", lambda r: F.struct(r["node_id"].alias("_ref"))).alias("nd")
    save(refs.join(tags, "way_id", "left").select(F.col("way_id").alias("_id"), nd, listed("tags")), "way", "ways")


def way_nodes(ways: DataFrame) -> DataFrame:
    """Long form: way_id, seq, node_id."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id"))


def extract_region(nodes: DataFrame, ways: DataFrame, relations: DataFrame, regions: DataFrame, pad: float = 0.001) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What lies in each region, with region_key: nodes in it; ways with a node in it; multipolygon relations with such a way, and their
    member ways; and the nodes of all these ways within a padded box. What lies in several regions has a row for each.

    Regions are met on cells and once for all; from there on joins are on ids and region keys, and only ids are joined.
    """
    at = ["region_key", "id"]
    places = nodes.select("id", "lat", "lon")
    inside = points_in_region(places, regions).select(*at)
    padded = points_in_region(places, region_expand(regions, pad)).select(*at)
    refs = way_nodes(ways).select("way_id", F.col("node_id").alias("id"))
    touching = refs.join(inside, "id").select("region_key", "way_id").distinct()
    members = relations.filter(F.coalesce(F.col("tags")["type"] == "multipolygon", F.lit(False))).select("id", F.explode("members").alias("m")).filter("m.type = 'way'").select("id", F.col("m.ref").alias("way_id"))
    rel_ids = members.join(touching, "way_id").select(*at).distinct()
    all_ways = touching.unionByName(members.join(rel_ids, "id").select("region_key", "way_id")).distinct()
    near = padded.join(refs.join(all_ways, "way_id").select(*at).distinct(), at, "left_semi")
    own_nodes = inside.unionByName(near).distinct()
    return nodes.join(own_nodes, "id"), ways.join(all_ways.withColumnRenamed("way_id", "id"), "id"), relations.join(rel_ids, "id")
