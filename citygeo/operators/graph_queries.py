"""Questions about a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citygeo.operators.graph import NODE_NAMES

DERIVED_EDGES = ["Contains", "FrontsOnto"]


def count_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("nodes"))


def count_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("edges"))


def nodes_of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.filter(F.col("node_type") == node_type)


def flagged_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.size("flags") > 0)


def group_by_name(members: DataFrame, name: str) -> DataFrame:
    return members.filter(F.col("name") == name)


def neighbours(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges out of and into the wanted nodes (node_id), with type and name of the other end, distance and cutoff."""
    far = nodes.select(F.col("node_id").alias("other"), F.col("node_type").alias("other_type"), F.col("name").alias("other_name"))
    cols = ["node_id", "direction", "edge_type", "other", "value", "tolerance_m"]
    out = edges.join(wanted.select(F.col("node_id").alias("src")), "src").select(F.col("src").alias("node_id"), F.lit("out").alias("direction"), "edge_type", F.col("dst").alias("other"), "value", "tolerance_m")
    into = edges.join(wanted.select(F.col("node_id").alias("dst")), "dst").select(F.col("dst").alias("node_id"), F.lit("in").alias("direction"), "edge_type", F.col("src").alias("other"), "value", "tolerance_m")
    return out.unionByName(into).join(far, "other").select(*cols, "other_type", "other_name")


def matches(text: str) -> Column:
    """Case-insensitive search in subtype, name, type and id."""
    return F.lit(text == "") | F.contains(F.lower(F.concat_ws(" ", "subtype", "name", "node_type", F.col("osm_id").cast("string"))), F.lit(text.lower()))


def explorer_rollup(nodes: DataFrame, text: str = "") -> DataFrame:
    """Counts and flagged counts by type, by type and subtype, and over all. level: 0 subtype, 1 type, 3 all."""
    own = nodes.filter(matches(text)).withColumn("flagged", (F.size("flags") > 0).cast("int"))
    return own.rollup("node_type", "subtype").agg(F.grouping_id().alias("level"), F.count("*").alias("nodes"), F.sum("flagged").alias("flagged"))


def type_order() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in NODE_NAMES]), F.col("node_type"))


def present_types(nodes: DataFrame) -> DataFrame:
    """Types there are, in declaration order."""
    return count_nodes(nodes).withColumn("position", type_order()).orderBy("position")


def subtype_frequency(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type", "subtype").agg(F.count("*").alias("nodes")).orderBy("node_type", F.desc("nodes"), "subtype")


def visible_nodes(nodes: DataFrame, hidden: DataFrame) -> DataFrame:
    """hidden: (node_type), a list of at most as many rows as there are types."""
    return nodes.join(F.broadcast(hidden.filter(F.col("node_type").isin(list(NODE_NAMES))).distinct()), "node_type", "left_anti")


def inspect_nodes(nodes: DataFrame) -> DataFrame:
    """A line for each node: metrics above 0, flags, and tags in key order."""
    metric = lambda k: F.when(F.col(f"metrics.{k}") > 0, F.col(f"metrics.{k}")).alias(k)
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return nodes.select("node_id", "node_type", "name", metric("area_m2"), metric("length_m"), metric("height_m"), metric("width_m"), F.array_join(F.array_sort("flags"), ";").alias("flags"), tags.alias("tags"))


def graph_summary(nodes: DataFrame, edges: DataFrame, members: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """section, name, count, derived: totals, nodes and edges by type (derived edges marked), groups and their sizes. counted:
    (edge_type, edges), numbers of edges of types that edges do not hold."""
    row = lambda section, name, n, derived=None: [F.lit(section).alias("section"), name.alias("name"), n.alias("count"), (F.lit(False) if derived is None else derived).alias("derived")]
    one = F.count("*")
    kinds = count_edges(edges) if counted is None else count_edges(edges).unionByName(counted.filter("edges > 0"))
    parts = [
        nodes.agg(one.alias("n")).select(*row("total", F.lit("nodes"), F.col("n"))),
        kinds.agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("n")).select(*row("total", F.lit("edges"), F.col("n"))),
        count_nodes(nodes).select(*row("node", F.col("node_type"), F.col("nodes"))),
        kinds.select(*row("edge", F.col("edge_type"), F.col("edges"), F.col("edge_type").isin(DERIVED_EDGES))),
        members.groupBy("kind", "name").agg(one.alias("n")).select(*row("group", F.concat_ws(":", "kind", "name"), F.col("n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
