"""What only larger tables show: ties, limits of one document, sizes of tasks."""

from __future__ import annotations

import oracle
import pytest
from pyspark.sql import functions as F

from basketry import registry
from basketry.operators import market

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_nearest_counts_in_millimetres(spark):
    rows = [("a", 9, 55.0, 37.0), ("a", 3, 55.0, 37.0 + 1e-12), ("b", 5, 55.0, 37.1), ("b", 4, 55.0, 37.1 + 2e-12)]
    got = market.nearest(spark.createDataFrame(rows, "chain string, point long, lat double, lon double"), F.lit(55.0), F.lit(36.0), ["chain"])
    assert {r.chain: r.point for r in got.collect()} == {"a": 3, "b": 4}


def test_a_brand_with_more_rows_than_a_bundle_holds(spark, tmp_path):
    spark.range(60_000).select(F.col("id").alias("p_partkey"), F.lit("bolt").alias("p_name"), F.lit("Brand#1").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.skipped: r["count"] for r in QUERIES["price_bundles"](spark, str(tmp_path)).groupBy("skipped").count().collect()}
    ids = range(60_000)
    fine = [k for k in ids if k % 7 and k % 11]
    assert got == {None: len(fine), "repeated": sum(k % 13 == 0 for k in fine), "no price": sum((1 + (k % 13 == 0)) for k in ids if k % 11 == 0), "no name": sum((1 + (k % 13 == 0)) for k in ids if k % 7 == 0 and k % 11)}


def test_half_a_kopeck_of_a_discount_goes_to_the_even_one(spark):
    from basketry.operators import optimise

    lines = spark.createDataFrame([(1, 1, p, v, 10.0, p) for p, v in enumerate([0.25, 0.75, 19.0])], "basket_id long, store long, product_id long, value double, discount double, position long")
    got = {r.product_id: round(r.share * 100) for r in optimise.share_discount(lines).collect()}
    assert got == {0: 12, 1: 38, 2: 950}


def test_missing_pairs_are_not_shuffled(spark):
    """More shops than one list holds, an unknown item and an unknown shop; nothing is exchanged once pairs are opened."""
    shops, items = [*range(2500), None], [0, 1, 2, None]
    known = [(i, s) for i in (0, 1) for s in range(2500) if (s + i) % 5] + [(2, None), (None, 7)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = market.missing_pairs(df([(i,) for i in items], "item long"), df([(s,) for s in shops], "shop long"), df(known, "item long, shop long"))
    got = [tuple(r) for r in out.collect()]
    want = {(i, s) for i in items for s in shops} - {k for k in known if None not in k}
    assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")


def test_copies_of_asked_words_meet_rows_once(spark):
    """4,000 wanted rows of two kinds; a row twice in the table ties with itself; frequent words beside words that no row has."""
    from basketry.operators import link

    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["d", "b", "a"]), (4, ["a", "x", "y"])], "id long, fwords array<string>")
    wanted = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.concat(F.lit("size"), "id"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("d"))).alias("fwords"))
    got = {r.wanted_id: r.id for r in link.unique_by_words(wanted, rows).collect()}
    assert got == {i: 1 for i in range(0, 4000, 2)}


def test_links_of_equal_weight_meet_skus_once(spark):
    """Brute force over every link and SKU: unknown weights, prices and stock, products of two items; equal links are not joined one by one."""
    from basketry.operators import link

    links = [(p, p % 5 if p % 11 else None, f"m{p % 3}", [25.0, None, 30.0][p % 3]) for p in range(60)] + [(3, 4, "m0", 10.0)]
    skus = [(k, k % 5, f"c{k % 3}", [10.0, 20.0, 28.0, None][k // 3 % 4], None if k % 4 == 0 else 1.0, [True, False, None][k // 7 % 3]) for k in range(300)]
    got = link.materialize(spark.createDataFrame(links, "product_id long, item_id long, method string, weight_g double"), spark.createDataFrame(skus, "sku long, item_id long, chain string, sku_weight_g double, price double, in_stock boolean"))
    want: dict = {}
    for p, i, _, w in links:
        for k, j, c, g, price, stock in skus:
            if i is not None and i == j:
                key = (price is None, stock is False, 0.0 if w is None or g is None else abs(w - g), k)
                want[p, c] = min(want.get((p, c), key), key)
    assert {(r.product_id, r.chain): r.sku for r in got.collect()} == {k: v[3] for k, v in want.items()}


def test_copies_of_a_place_ask_once(spark, monkeypatch):
    from basketry.operators import tiles

    met, join = [], tiles.tiled_join
    monkeypatch.setattr(tiles, "tiled_join", lambda a, b, keys, **k: met.append((a.count(), b.count())) or join(a, b, keys, **k))
    places = spark.range(3000).selectExpr("id AS place", "cast(55.0 AS double) AS lat", "cast(id % 2 AS double) AS lon")
    points = spark.range(3000).selectExpr("'c' AS chain", "id AS point", "cast(55.0 AS double) AS lat", "cast(id % 3 AS double) AS lon")
    got = {(r.place, r.rank): r.point for r in market.nearest_of_many(places, points, "chain", 2).collect()}
    assert got == {(p, n + 1): p % 2 + 3 * n for p in range(3000) for n in range(2)}
    assert max(a for a, _ in met) <= 27 * 2 and max(b for _, b in met) <= 6


def test_a_status_is_found_once_a_product(spark):
    plan = QUERIES["item_status"](spark, oracle.SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Generate" in line and "basket_id" in line for line in plan.splitlines())


def test_lines_of_a_cart_without_a_sum_do_not_move(spark):
    plan = QUERIES["cart_totals"](spark, oracle.SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Contains" in plan


def test_a_receipt_declares_its_own_total_without_a_shuffle(spark):
    from basketry.sources import files

    raw = spark.createDataFrame([(1, "SHOP\nbread 2 x 1,00 = 2,00\nИТОГО: 2,00"), (None, "milk 1 x 3,00 = 3,00\nВсего 3,00"), (None, "tea 1 x 4,00 = 4,00")], "key long, text string")
    out = files.receipt_lines(raw)
    assert [(r.key, r.position, r.name, r.qty, r.total, r.declared) for r in out.orderBy("name").collect()] == [(1, 1, "bread", 2.0, 2.0, 2.0), (None, 0, "milk", 1.0, 3.0, 3.0), (None, 0, "tea", 1.0, 4.0, None)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_product_move_once(spark):
    assert QUERIES["sane_minimum"](spark, oracle.SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
