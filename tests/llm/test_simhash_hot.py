"""Hot cells: bounded tiles that lose no pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.llm import simhash


def test_tiles_of_a_hot_cell_are_bounded_and_meet_every_pair(spark):
    n, hot = 900, 64
    rows = spark.range(n).select(F.lit(0).alias("block"), F.lit(5).cast("long").alias("shard"), (F.col("id") % 3 > 0).alias("home"), (F.col("id") * 8).alias("fp"))
    tiles = simhash.split_hot(rows, simhash.block_masks(3), 4, hot).cache()
    sizes = tiles.groupBy("tile").agg(F.sum(F.col("home").cast("int")).alias("h"), F.count("fp").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 4 * hot
    cell = "tile.part = 4 and tile.value = 0"  # the bits above all of these values
    pairs = tiles.filter(cell).alias("x").join(tiles.filter(cell).alias("y"), "tile").filter("x.home and x.fp <> y.fp").select("x.fp", "y.fp").distinct()
    assert pairs.count() == n * 2 // 3 * (n - 1)
    assert tiles.filter(cell).groupBy("tile", "fp").count().filter("count > 1").isEmpty()
    calm = simhash.split_hot(rows.limit(60), simhash.block_masks(3), 4, hot)
    assert calm.count() == 60
