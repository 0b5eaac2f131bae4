"""Asset rules and seeded weighted choice.

rules(rule_id, rule_order, node_type, subtype, seed, per_corridor) and choices(rule_id, idx, asset, label, weight) are small
tables, but no size is taken for granted: Spark's own size check decides whether joins with them broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citygeo.functions.numbers import case_of
from citygeo.operators.cut import cut
from citygeo.operators.spatial import few

# Kind of geometry that each node type puts out.
OUTPUT_KIND = {
    "Building": "point + polygon", ("RoadSegment", "Waterway", "Railway", "Barrier", "PowerLine"): "spline",
    ("WaterBody", "VegetationArea", "LanduseZone", "LeisureArea"): "polygon", "Amenity": "point", "TerrainTile": "landscape",
}
MODULUS, FACTOR, STEP = 2147483648, 1103515245, 12345


def choice_ratios(choices: DataFrame) -> DataFrame:
    """Adds ratio: weight over the rule's sum, negatives as 0; an even split where all are 0."""
    own = Window.partitionBy("rule_id")
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    total = F.sum(weight).over(own)
    return choices.withColumn("ratio", F.when(total > 0, F.try_divide(weight, total)).otherwise(F.lit(1.0) / F.count("*").over(own)))


def match_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule_id, seed and per_corridor of the node's rule: the first exact subtype, else the last type-wide one, else null."""
    item = F.struct("rule_id", "seed", "per_corridor")
    exact = rules.filter("subtype <> ''").groupBy("node_type", "subtype").agg(F.min_by(item, "rule_order").alias("_exact"))
    wide = rules.filter("subtype = ''").groupBy("node_type").agg(F.max_by(item, "rule_order").alias("_wide"))
    own = nodes.join(exact, ["node_type", "subtype"], "left").join(wide, "node_type", "left").withColumn("_rule", F.coalesce("_exact", "_wide"))
    return own.withColumns({k: F.col(f"_rule.{k}") for k in ("rule_id", "seed", "per_corridor")}).drop("_exact", "_wide", "_rule")


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (node_type, subtype, seed, rule_id, rule_order) replace rules of the same type and subtype; only roads choose by corridor."""
    new = changes.withColumn("per_corridor", F.col("node_type") == "RoadSegment")
    return rules.join(new.select("node_type", "subtype"), ["node_type", "subtype"], "left_anti").unionByName(new.select(rules.columns))


def roll(seed: Column, key: Column) -> Column:
    """A number in [0, 1) from two integers, by portable integer arithmetic; high bits are used."""
    mixed = F.pmod(F.pmod(seed.cast("long") * FACTOR + key.cast("long") * STEP, F.lit(MODULUS)) * FACTOR + STEP, F.lit(MODULUS))
    return mixed / float(MODULUS)


def pick_choice(wanted: DataFrame, choices: DataFrame) -> DataFrame:
    """wanted: (rule_id, seed, key) → adds idx, asset, label: the first choice with an asset at which the running sum of weights reaches
    the roll; an even choice if all weights are 0; null if no choice has an asset. The choices of a rule meet its rows as one array, so
    rows are neither grouped nor joined again."""
    usable = choices.filter("asset is not null and asset <> ''")
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    own = Window.partitionBy("rule_id")
    usable = usable.withColumn("_w", F.when(F.sum(weight).over(own) > 0, weight).otherwise(1.0))
    running = Window.partitionBy("rule_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = usable.withColumns({"_high": F.sum("_w").over(running), "_total": F.sum("_w").over(own)})
    lists = usable.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("idx", "asset", "label", "_high", "_total"))).alias("_choices"))
    reached = F.filter("_choices", lambda c: roll(F.col("seed"), F.col("key")) * c["_total"] <= c["_high"])
    met = wanted.join(lists, "rule_id", "left").withColumn("_best", F.get(reached, F.lit(0)))
    return met.select(*[F.col(c) for c in wanted.columns], "_best.idx", "_best.asset", "_best.label")


def text_key(text: Column) -> Column:
    """A portable integer of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def select_assets(nodes: DataFrame, rules: DataFrame, choices: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """node_id, node_type, subtype, corridor, idx, asset, label, outcome (and osm_id, if nodes have it) for all nodes but junctions and terrain.

    Roads whose rule is per corridor share one pick, seeded by the corridor's name: the least node id is selected, the rest
    inherit. members: (region_key, kind, name, node_id); or nodes have their corridor (graph.with_corridors). key_id of nodes, if there, seeds single picks, else node_id does.
    """
    own = match_rules(nodes.filter("node_type not in ('Junction', 'TerrainTile')"), rules)
    if "corridor" in nodes.columns:
        pass
    elif members is None:
        own = own.withColumn("corridor", F.lit(None).cast("string"))
    else:
        named = members.filter("kind = 'Corridor'").select("region_key", "node_id", F.col("name").alias("corridor"))
        own = own.join(named, ["region_key", "node_id"], "left")
    shared = F.coalesce(F.col("per_corridor"), F.lit(False)) & F.col("corridor").isNotNull()
    single = F.col("key_id") if "key_id" in nodes.columns else F.pmod("node_id", F.lit(MODULUS))
    own = own.withColumn("corridor", F.when(shared, F.col("corridor"))).withColumn("key", F.when(shared, text_key(F.col("corridor"))).otherwise(single))
    first = few(cut(own.filter("corridor is not null").groupBy("region_key", "node_type", "corridor").agg(F.min("node_id").alias("node_id")).select("region_key", "node_id", F.lit(True).alias("_first"))))
    outcome = F.when(F.col("rule_id").isNull(), F.lit("FallbackNoRule")).when(F.col("idx").isNull(), F.lit("FallbackNoAsset")).when(F.col("corridor").isNotNull() & F.col("_first").isNull(), F.lit("InheritedFromCorridor")).otherwise("Selected")
    source = ["osm_id"] if "osm_id" in nodes.columns else []
    return pick_choice(own, choices).join(first, ["region_key", "node_id"], "left").withColumn("outcome", outcome).select("region_key", "node_id", "node_type", "subtype", "corridor", "idx", "asset", "label", "outcome", "flags", *source)


def dry_run(selections: DataFrame) -> DataFrame:
    """Per type: nodes, selected, fallbacks, flagged, output_kind."""
    fallback = F.col("outcome").startswith("Fallback")
    return selections.groupBy("node_type").agg(F.count("*").alias("nodes"), F.count_if(~fallback).alias("selected"), F.count_if(fallback).alias("fallbacks"), F.count_if(F.size("flags") > 0).alias("flagged")).withColumn("output_kind", case_of(F.col("node_type"), OUTPUT_KIND, "none"))


def dry_run_assets(selections: DataFrame) -> DataFrame:
    """Per type and label: count and percentage of the type's selected nodes."""
    own = selections.filter(~F.col("outcome").startswith("Fallback")).withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "asset"))
    return own.groupBy("node_type", "label").count().withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("node_type")))


def corridor_sizes(selections: DataFrame, top: int = 8) -> DataFrame:
    """The largest corridors among selected nodes: a report of ``top`` rows."""
    own = selections.filter(F.col("corridor").isNotNull() & ~F.col("outcome").startswith("Fallback"))
    return own.groupBy("corridor").count().orderBy(F.desc("count"), "corridor").limit(top)
