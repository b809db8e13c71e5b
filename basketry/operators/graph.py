"""Components and chains over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import beside, dealt, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b): smallest labels and pointer jumping."""
    once = written(edges.select("a", "b"), "links")
    rows = 2 * once.count()
    ways = once.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way"))
    two = written(dealt(ways.select("way.*"), rows, "a", "b").distinct(), "edges")
    label = two.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node")
    label = written(label, "component", rows)
    # labels of many nodes are small files but large tables: such are sorted and merged, not sent to every task through the driver
    nodes = label.count()
    while True:
        near = two.join(beside(label.withColumnRenamed("node", "b"), nodes), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        step = written(label.join(beside(near, nodes), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")), "component", rows)
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label = written(step.join(beside(jump, nodes), "component").select("node", "was", F.col("up").alias("component")), "component", rows)
        if label.filter("component <> was").isEmpty():
            return label.select("node", "component")
        label = label.select("node", "component")


def resolve_aliases(aliases: DataFrame, alive: DataFrame, hops: int = 16) -> DataFrame:
    """old, target: where every alias ends after ``hops`` steps at most; null if it ends at no living id or in a cycle."""
    ends = aliases.select("old", F.col("new").alias("target"))
    steps = 1
    while steps < hops:  # doubling: each round follows the ends of the round before
        nxt = written(ends, "alias").select(F.col("old").alias("target"), F.col("target").alias("next"))
        ends = written(ends, "alias").join(nxt, "target", "left").select("old", F.coalesce("next", "target").alias("target"))
        steps *= 2
    return ends.join(alive.select(F.col("id").alias("target"), F.lit(True).alias("lives")), "target", "left").select("old", F.when(F.col("lives"), F.col("target")).alias("target"))
