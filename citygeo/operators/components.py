"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygeo.operators.cut import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of nodes (node) and edges (a, b); both are longs.

    Each round hangs every node under the least root that it or a neighbour knows, and then shortens paths by one jump, so the
    number of rounds grows with the logarithm of the longest chain. A round is cut from its lineage; only a count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = cut(both)
    state = nodes.select("node").union(both.select("a")).distinct().withColumn("root", F.col("node"))
    while True:
        state = cut(state)
        around = both.join(state.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        own = state.join(around, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        # what a node learns holds for its root too
        told = own.groupBy("root").agg(F.min("low").alias("told")).withColumnRenamed("root", "of")
        hung = own.join(told, F.col("root") == F.col("of")).select("node", "root", F.least("low", "told").alias("low"))
        jump = hung.select(F.col("node").alias("at"), F.col("low").alias("beyond"))
        moved = cut(hung.join(jump, F.col("low") == F.col("at")).select("node", "root", F.col("beyond").alias("low")))
        state = moved.select("node", F.col("low").alias("root"))
        if not moved.filter("low <> root").limit(1).count():
            return state
