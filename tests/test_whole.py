"""Queries over whole tables: every row counts, and those without SQL agree with brute force."""

from __future__ import annotations

import oracle
import pytest
from pyspark.sql import functions as F

from basketry import registry

QUERIES = registry.queries()


@pytest.mark.parametrize(
    "name,key",
    [("store_totals", "basket_id"), ("line_baselines", "basket_id"), ("shared_discounts", "basket_id"), ("covered_baseline", "basket_id"), ("receipt_bundles", "key"), ("receipt_texts", "key"), ("pasted_receipts", "key"), ("plan_check", "basket_id")],
)
def test_every_order_is_read(spark, name, key):
    got = {int(r[0]) for r in QUERIES[name](spark, oracle.SF).select(key).distinct().collect()}
    assert got == {r[0] for r in registry.table(spark, oracle.SF, "lineitem").select("l_orderkey").distinct().collect()}


def test_every_line_is_reported(spark):
    assert QUERIES["device_reports"](spark, oracle.SF).agg(F.sum("n")).first()[0] == registry.table(spark, oracle.SF, "lineitem").count()


def test_a_chain_that_is_fresh_by_any_event_counts(spark, tmp_path):
    rows = [(1, "a", "2024-01-29 20:00:00"), (50, "b", "2024-01-29 20:00:00"), (50, "c", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "event_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.chain for r in QUERIES["fresh_chains"](spark, str(tmp_path)).collect()} == {"a", "b"}


def test_components_of_real_keys(spark, tmp_path):
    edges = [(0, 0, 1), (0, 1, 2), (61, 1, 3), (60, 2, 4), (7, 60, 5), (7, 61, 80), (120, 3, 41), (120, 2, 42)]  # folded by 60, all of them would meet
    spark.createDataFrame(edges, "l_partkey long, l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for p, s, _ in edges:
        a, b = find(2 * p), find(2 * s + 1)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in QUERIES["match_components"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in up}


def test_every_item_meets_every_shop(spark, tmp_path):
    known = [(p, s) for p in range(7) for s in range(40) if (p * s) % 3 == 1]
    spark.createDataFrame([(p, s, 100 + p) for p, s in known], "l_partkey long, l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s,) for s in range(45)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = [(r.item, r.shop) for r in QUERIES["coverage"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted({(p, s) for p, _ in known for s in range(45)} - set(known))


def test_status_of_all_lines_in_all_stores(spark):
    li = registry.table(spark, oracle.SF, "lineitem").select("l_orderkey", "l_partkey").distinct().count()
    assert QUERIES["item_status"](spark, oracle.SF).count() == 10 * li


def test_leaves_of_the_whole_tree(spark):
    n = registry.table(spark, oracle.SF, "part").count()
    ids = set(range(1, n + 1))
    assert {r.id for r in QUERIES["category_paths"](spark, oracle.SF).collect()} == ids - {k // 3 for k in ids}


def test_all_pairs_of_stores(spark, tmp_path):
    from itertools import product

    rows = [(o, 10 * o + i, 4 * (i % 2) + s, float(7000 + (o * 7919 + i * 104729 + s * 31337) % 60000)) for o in range(12) for i in range(5) for s in range(4) if (o + i * s) % 4]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s,) for s in range(8)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")

    def cost(store, subtotal):
        off = round(min(subtotal * 0.05, 10000)) if store == 2 and subtotal >= 50000 else 0
        return subtotal + (0 if subtotal >= 60000 + 10000 * store else 9000 + 1000 * store) + (1e9 if subtotal < 10000 * store else 0) - off + 500 * store

    want = {}
    for o in {r[0] for r in rows}:
        price: dict = {}
        for _, p, s, v in (r for r in rows if r[0] == o):
            price.setdefault(p, {})[s % 4] = v
        for pair in [(a, b) for a in range(4) for b in range(a, 4)]:
            lines = [{s: v for s, v in at.items() if s in pair} for at in price.values()]
            have = [x for x in lines if x]
            for pick in product(*have) if have else []:
                sub = {s: sum(x[k] for x, k in zip(have, pick, strict=True) if k == s) for s in set(pick)}
                row = (len(lines) - len(have), round(sum(cost(s, v) for s, v in sub.items())))
                want[o] = min(want.get(o, row), row)
    got = {r.basket_id: (r.missing, r.cost) for r in QUERIES["split_two_stores"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[o] == pytest.approx(want[o], abs=2) for o in want)
