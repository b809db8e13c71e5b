"""Cases of the third round's findings, named by their numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from basketry import session
from basketry.operators import compare, graph, optimise, resolve, workspace
from basketry.plans import baskets
from basketry.sources import files


def test_f10_pasted_lines_are_read_once(spark):
    rows = [(1, "сыр; 2; 1 234,50 ₽\nхлеб\t45,9\nмолоко 3,2% 89 руб.\n\nбез цены\n;;\n5;x;7"), (2, None), (3, "a;1,234;5,678.25;b\r\nc 1e5")]
    raw = spark.createDataFrame(rows, "key int, text string")
    ok = files.pasted_lines(raw).filter("ok")
    got = [(r.key, r.position, r.name, r.qty, r.price) for r in ok.orderBy("key", "position").collect()]
    assert got == [(1, 0, "сыр", 2.0, 1234.5), (1, 1, "хлеб", 1.0, 45.9), (1, 2, "молоко 3,2%", 1.0, 89.0), (3, 0, "a", 1234.0, 5678.25)]
    plan = ok._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 3  # the name, twice, and the price; a pushed filter had all of it again


def test_f11_f15_f16_tasks_grow_with_rows(spark, monkeypatch):
    few = str(2 * int(spark.conf.get(session.PARTITIONS)))
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    rows = 100 * int(few)
    assert session.dealt(spark.range(rows), rows, "id").rdd.getNumPartitions() == int(few)
    before = spark.conf.get(session.PARTITIONS)
    session.written(spark.range(rows), "dealt", rows)
    assert spark.conf.get(session.PARTITIONS) == before


def test_f11_store_totals_sends_no_table_of_baskets(spark, tmp_path):
    li = [(k, k % 7 + n, n, 100.0 * (n + 1)) for k in range(20) for n in range(3)]
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(n,) for n in range(3)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    out = baskets.store_totals(spark, str(tmp_path))
    assert out.count() == 60 and {r.missing for r in out.collect()} == {2}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2 and "SortMergeJoin" in plan  # the stores only; a plan that ran is shown twice


def test_f15_components_of_repeated_edges_both_ways(spark):
    edges = [(1, 2), (2, 1), (1, 2), (3, 2), (9, 8), (7, 7)]
    for least in (1, 10**6):
        session.ROWS_A_TASK, was = least, session.ROWS_A_TASK
        try:
            got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        finally:
            session.ROWS_A_TASK = was
        assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 7: 7}


def test_f16_compared_products_are_merged(spark):
    products = spark.createDataFrame([(k,) for k in range(6)], "product_id long")
    stores = spark.createDataFrame([("a",), ("b",)], "store string")
    maps = spark.createDataFrame([(0, "a", "x", "pcs", 500.0), (1, "a", None, "pcs", 500.0), (2, "b", "x", "pcs", 500.0)], "product_id long, store string, sku string, unit string, weight_g double")
    prices = spark.createDataFrame([("a", "x", 10.0, True), ("b", "x", None, True)], "store string, sku string, price double, in_stock boolean")
    out = compare.compare_products(products, stores, maps, prices)
    got = {(r.product_id, r.store): (r.sku, r.price, r.note) for r in out.collect()}
    assert len(got) == 12 and got[0, "a"] == ("x", 10.0, None) and got[1, "a"] == (None, None, "not mapped") and got[2, "b"] == ("x", None, "no fresh price") and got[5, "b"] == (None, None, "not mapped")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_f12_documents_are_read_once(spark, tmp_path):
    state = workspace.empty_state(spark)
    body = '{"products":[{"id":-1},{"id":7,"name":"Part 1"},{"id":-2},{"id":-1,"name":"x"},5],"baskets":[{"id":4,"name":"a"},{"id":0},{"id":-3},{"id":4,"name":"b"}],' \
           '"basketItems":{"4":[{"product_id":-1,"qty":2},{"product_id":7,"qty":1,"fallback_product_id":2},{"product_id":99,"qty":1}],"-3":[{"product_id":-2,"qty":"3"}]},"address":null}'  # fmt: skip
    docs = spark.createDataFrame([("w", 1, body), ("v", 1, "[]"), ("w", 1, "~")], "workspace string, version int, document string")
    catalog = spark.createDataFrame([(1, "part 1"), (2, "part 2")], "item_id long, name string").selectExpr("*", "null AS brand", "double(null) AS weight_g", "'pcs' AS unit", "null AS category")
    after = workspace.apply_documents(state, docs, catalog, spark.range(0).toDF("store_id"), spark.createDataFrame([], "chain string"), "2024-01-01")
    rows = lambda name, *c: sorted(tuple(r) for r in after[name].select(*c).collect())
    assert rows("products", "product_id", "name") == [(1, "part 1"), (2, "Part 1"), (3, "part 2")]
    assert rows("baskets", "basket_id", "name") == [(4, "b"), (5, workspace.BASKET), (6, workspace.BASKET)]
    assert rows("items", "basket_id", "product_id", "qty", "fallback_product_id") == [(4, 1, 2.0, None), (4, 2, 1.0, 2), (6, 3, 3.0, None)]
    read = workspace._entries(spark.createDataFrame([("w", ['{"id":1}'])], "workspace string, l array<string>"), F.col("l")).filter(F.col("e")["id"] == "1")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_f17_only_lines_with_a_choice_make_splits():
    pay = np.full((2, 40, 2), np.inf)  # forty lines: all splits of them would not fit in memory
    pay[0, np.arange(40), np.arange(40) % 2] = 10_000.0
    pay[1, :38, 0] = 10_000.0
    pay[1, 36:39, 1] = 9_000.0
    none = dict.fromkeys(optimise.SHOP_FIELDS)
    cost, at = optimise._best_splits(pay, pay.copy(), [none, none | {"fee": 15.0}])
    assert cost.tolist() == [401_500.0, 38 * 10_000 - 2_000 + 9_000 + 1_500]
    assert at[0].tolist() == [k % 2 for k in range(40)] and at[1].tolist() == [0] * 36 + [1, 1, 1, 0]


def test_f8_many_rows_are_never_sent_to_every_task(spark, monkeypatch):
    catalog = spark.createDataFrame([(k, "ab"[k % 2], f"сыр сорт{k // 3} 200 г", "сыр", k if k % 4 == 0 else None) for k in range(24)], "id long, chain string, name string, brand string, item_id long")
    catalog = catalog.selectExpr("*", "double(null) AS weight_g", "'pcs' AS unit", "string(null) AS barcode")
    want = sorted(tuple(r) for r in resolve.match_all(catalog).collect())
    monkeypatch.setattr(session, "ROWS_A_TASK", 8)
    out = resolve.match_all(catalog)
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) == 24
    rows = session.written(resolve.prepare(catalog), "prepared")
    for df in (out, resolve.with_reps(rows, 24), resolve.cluster(rows, resolve.match_edges(rows))):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
