"""Cases of the fourth round's findings, named by their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import market
from basketry.plans import market as plans


def test_f1_coverage_sends_no_list_to_the_driver(spark, tmp_path):
    """A list of shops is there once for each tile of items: 60 times sf0.1 have 0.6 GB of them, however small the file of shops is."""
    spark.range(300).select(F.col("id").alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    out = plans.coverage(spark, str(tmp_path))
    assert out.count() == out.distinct().count() == 300 * 49
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_f1_coverage_of_many_tiles_and_well_known_items(spark, monkeypatch):
    """More tiles than one block has, lists with few, many and all shops known, repeated mappings, unknown keys, foreign items and shops."""
    monkeypatch.setattr(market, "LISTED", 4)
    monkeypatch.setattr(market, "SCANNED", 2)
    shops, items = [*range(30), None], [*range(90), None]
    known = [(i, s) for i in range(90) for s in range(30) if i % 3 and (i * s) % 7 < i % 8] * 2 + [(5, None), (None, 5), (900, 5), (5, 900)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = market.missing_pairs(df([(i,) for i in items * 2], "item long"), df([(s,) for s in shops * 2], "shop long"), df(known, "item long, shop long"))
    got = [tuple(r) for r in out.collect()]
    want = {(i, s) for i in items for s in shops} - {k for k in known if None not in k}
    assert len(got) == len(want) and set(got) == want
    assert market.missing_pairs(df([], "item long"), df([(1,)], "shop long"), df([(1, 1)], "item long, shop long")).count() == 0
    assert market.missing_pairs(df([(1,)], "item long"), df([], "shop long"), df([(1, 1)], "item long, shop long")).count() == 0
