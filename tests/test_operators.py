from __future__ import annotations

import datetime as dt
import random
from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.operators import carts, graph, habits, health, history, link, market, optimise, receipts, resolve

DAY = dt.datetime(2024, 5, 1)


def test_change_log_and_usual_price(spark):
    rows = [("m", "a", 100.0, 0), ("m", "a", 100.0, 1), ("m", "a", 100.003, 2), ("m", "a", 200.0, 3), ("m", "a", 50.0, 4), ("n", "a", 7.0, 1)]
    df = spark.createDataFrame([(c, s, p, DAY + dt.timedelta(days=d)) for c, s, p, d in rows], "chain string, sku string, price double, seen_at timestamp")
    log = history.change_log(df, ["chain", "sku"], ["seen_at"])
    assert [r.price for r in log.filter("chain = 'm'").orderBy("seen_at").collect()] == [100.0, 200.0, 50.0]
    usual = history.usual_price(log, ["chain", "sku"], "seen_at").filter("chain = 'm'").orderBy("seen_at").collect()
    assert [(r.usual, r.trusted) for r in usual] == [(100.0, False), (200.0, False), (100.0, True)]


def test_upsert_is_idempotent_and_keeps_what_is_known(spark):
    schema = "chain string, sku string, name string, weight_g double, category string, brand string, unit string, url string, image string, barcode string, price double, in_stock boolean"
    state = ", first_seen timestamp, last_seen timestamp, price_seen timestamp, active boolean, item_id long, prev_item_id long"
    old = spark.createDataFrame([("m", "1", "Сыр", 200.0, None, "Ламбер", "pcs", "u", None, None, 100.0, True, DAY, DAY, DAY, False, 5, None)], schema + state)
    new = spark.createDataFrame([("m", "1", "Сыр новый", 180.0, None, None, None, None, "i", None, None, None, False), ("m", "2", "Чай", None, None, None, None, None, None, None, 10.0, None, True)], schema + ", price_from_base boolean")
    at = F.lit(DAY + dt.timedelta(days=1))
    once = history.upsert_catalog(old, new, at)
    r = {x.sku: x for x in once.collect()}
    assert (r["1"].brand, r["1"].price, r["1"].weight_g, r["1"].item_id, r["1"].prev_item_id, r["1"].active) == ("Ламбер", 100.0, 180.0, None, 5, True)
    assert r["1"].price_seen == DAY and r["2"].price_seen is None
    twice = history.upsert_catalog(once, new, at)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_price_as_of_never_takes_another_point(spark):
    now = DAY + dt.timedelta(hours=5)
    rows = [(1, "a", 10.0, DAY + dt.timedelta(hours=4), "feed", "other"), (2, "a", 20.0, DAY + dt.timedelta(hours=1), "feed", None), (3, "a", 30.0, DAY, "cart", None), (4, "b", 5.0, DAY - dt.timedelta(days=3), "feed", None)]
    df = spark.createDataFrame(rows, "id long, sku string, price double, fetched_at timestamp, source string, point_key string")
    got = history.price_as_of(df, ["sku"], F.lit(now), F.lit("mine"), 6).collect()
    assert [(r.sku, r.price) for r in got] == [("a", 30.0)]


def test_null_stock_is_not_absence(spark):
    a = spark.createDataFrame([("m", "x", 10.0, None), ("l", "x", 20.0, True)], "chain string, sku string, price double, in_stock boolean")
    b = spark.createDataFrame([("m", "x", 9.0, None)], "chain string, sku string, price double, in_stock boolean")
    got = {r.chain: (r.my_price, r.available) for r in market.price_for_me(a, b, ["chain", "sku"], ["l", "m"]).collect()}
    assert got == {"m": (9.0, True), "l": (None, True)}


def test_orderable_keeps_rows_without_a_shop(spark):
    h = spark.createDataFrame([(None, "хлеб"), ("x", "чай"), ("ok", "Доставка заказа"), ("ok", "сок")], "shop string, name string")
    got = habits.orderable(h, spark.createDataFrame([("x",)], "shop string"), receipts.is_service(F.col("name")))
    assert sorted(r.name for r in got.collect()) == ["сок", "хлеб"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_components_property(spark, pairs):
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {n: n for p in pairs for n in p}
    for _ in range(30):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_aliases_end_alive_or_nowhere(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 7)], "old long, new long")
    alive = spark.createDataFrame([(3,), (7,)], "id long")
    assert {r.old: r.target for r in graph.resolve_aliases(a, alive).collect()} == {1: 3, 2: 3, 4: None, 5: None, 6: 7}


CATALOG = "id long, chain string, name string, brand string, weight_g double, unit string, barcode string, item_id long"


def resolved(spark, rows):
    df = spark.createDataFrame([(i, c, n, b, None, "pcs", code, None) for i, c, n, b, code in rows], CATALOG)
    p = resolve.prepare(df)
    items = {r.id: r.item for r in resolve.split_chained(p, resolve.cluster(p, resolve.match_edges(p))).collect()}
    groups: dict = {}
    for i, g in items.items():
        groups.setdefault(g, set()).add(i)
    return sorted(sorted(g) for g in groups.values())


def test_resolution_guards(spark):
    rows = [
        (1, "a", "Сметана Большая кружка 15% 300г", None, None), (2, "b", "Сметана Большая кружка 15 % 300 г", None, None), (3, "c", "Сметана Большая кружка 20% 300г", None, None),
        (4, "a", "Вода Родник без газа 1,5л", None, None), (5, "b", "Вода Родник газированная 1,5л", None, None),
        (6, "a", "Масло сливочное Ичалки 500г", None, None), (7, "b", "maslo slivochnoe ichalki 500g", None, None),
        (8, "a", "Чай чёрный", None, "4607084350029"), (9, "b", "Совсем другое имя", None, "4607084350029"),
    ]
    assert resolved(spark, rows) == [[1, 2], [3], [4], [5], [6, 7], [8, 9]]


def test_a_silent_row_does_not_hold_contradictions_together(spark):
    rows = [(1, "a", "Сметана Кружка 15% 300г", None, None), (2, "b", "Сметана Кружка 300г", None, None), (3, "c", "Сметана Кружка 20% 300г", None, None)]
    parts = resolved(spark, rows)
    assert not any({1, 3} <= set(p) for p in parts) and sum(map(len, parts)) == 3


def test_resolution_does_not_depend_on_order(spark):
    rows = [(i, "abc"[i % 3], f"Печенье Юбилейное {('какао', 'молочное')[i % 2]} {100 + 10 * (i % 4)}г", None, None) for i in range(1, 25)]
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    assert resolved(spark, rows) == resolved(spark, shuffled)


def test_ids_are_kept_by_votes(spark):
    items = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)], "id long, item long")
    before = spark.createDataFrame([(1, 50), (2, 50), (3, 60), (4, 60), (5, 70), (6, None)], "id long, item_id long")
    got = {r["item"]: r.item_id for r in resolve.keep_ids(items, before).collect()}
    assert got[1] == 50 and got[4] == 60 and got[6] > 70
    after = items.join(spark.createDataFrame(list(got.items()), "item long, item_id long"), "item")
    assert {r.old: r.new for r in resolve.aliases(before, after).collect()} == {70: 60}


def brute(lines, stores):
    """Least (missing, cost) over one or two stores, in kopecks."""
    best = None
    for pair in [(s,) for s in stores] + [(a, b) for a in stores for b in stores if a < b]:
        have = [p for p in lines if any(s in lines[p] for s in pair)]
        for at in product(pair, repeat=len(have)):
            if not have or any(s not in lines[p] for p, s in zip(have, at, strict=True)):
                continue
            cost = 0
            for s in set(at):
                f = stores[s]
                sub = sum(round(100 * lines[p][s]) for p, x in zip(have, at, strict=True) if x == s)
                off = min(sub * f["percent"] / 100, 100 * f["cap"]) if sub >= 100 * f["min_check"] else 0
                cost += sub + (0 if sub >= 100 * f["free_from"] else 100 * f["fee"]) + (1e9 if sub < 100 * f["min_order"] else 0) - round(off) + 100 * f["penalty"]
            key = (len(lines) - len(have), cost)
            best = key if best is None or key < best else best
    return best


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_split_is_exact(spark, data):
    prices = st.dictionaries(st.sampled_from(["a", "b", "c"]), st.integers(10, 900).map(float), min_size=1, max_size=3)
    lines = {p: data.draw(prices) for p in range(1, data.draw(st.integers(1, 6)) + 1)}
    num = lambda lo, hi: float(data.draw(st.integers(lo, hi)))
    stores = {s: {"fee": num(0, 200), "free_from": num(300, 2000), "min_order": num(0, 600), "penalty": num(0, 50), "percent": num(0, 10), "cap": num(0, 100), "min_check": num(0, 800), "cap_used": 0.0} for s in "abc"}
    df = spark.createDataFrame([(1, p, s, v, 0.0, True) for p, x in lines.items() for s, v in x.items()], "basket_id long, product_id long, store string, value double, adjust double, in_stock boolean")
    shops = spark.createDataFrame([(s, *[f[c] for c in optimise.SHOP_FIELDS]) for s, f in stores.items()], "store string, " + ", ".join(f"{c} double" for c in optimise.SHOP_FIELDS))
    got = optimise.split_baskets(df, shops, keep=1).first()
    assert (got.missing, got.cost) == pytest.approx(brute(lines, stores), abs=2)


def test_discount_shares_add_up(spark):
    df = spark.createDataFrame([(1, "a", i, v, 10.0) for i, v in enumerate([33.33, 33.33, 33.34])], "basket_id long, store string, position int, value double, discount double")
    assert sum(r.share for r in optimise.share_discount(df).collect()) == pytest.approx(10.0)


def test_status_and_substitutes(spark):
    items = spark.createDataFrame([(1, 10), (1, 11)], "basket_id long, product_id long")
    maps = spark.createDataFrame([(11, "a"), (10, "b")], "product_id long, store string")
    prices = spark.createDataFrame([(11, "a", 5.0, None), (10, "b", 6.0, False)], "product_id long, store string, price double, in_stock boolean")
    stores = spark.createDataFrame([("a",), ("b",)], "store string")
    got = {(r.product_id, r.store): r.status for r in carts.item_status(items, maps, prices, stores).collect()}
    assert got == {(10, "a"): "NOT_KNOWN", (10, "b"): "GONE", (11, "a"): "HAVE", (11, "b"): "NOT_KNOWN"}
    fallback = spark.createDataFrame([(1, 10, 11, "pcs", "pcs")], "basket_id long, product_id long, substitute long, unit string, sub_unit string")
    subs = carts.substitutes(carts.item_status(items, maps, prices, stores), fallback).collect()
    assert [(r.product_id, r.store, r.substitute) for r in subs] == [(10, "a", 11)]


def test_coupons(spark):
    prices = spark.createDataFrame([("a", "1", 100.0), ("a", "2", 50.0)], "store string, sku string, price double")
    coupons = spark.createDataFrame([(1, "a", "1", None, 10.0, None), (2, "a", "1", 80.0, None, None), (3, "a", "1", 120.0, None, None)], "coupon_id long, store string, sku string, coupon_price double, percent double, off double")
    assert {r.sku: (r.my_price, r.coupon_id) for r in carts.best_coupons(prices, coupons).collect()} == {"1": (80.0, 2), "2": (50.0, None)}


def test_night_is_the_session_with_most_runs(spark):
    at = [0, 10, 20, 200, 210, 900]
    runs = spark.createDataFrame([(DAY + dt.timedelta(minutes=m),) for m in at], "started_at timestamp")
    r = health.night(runs).first()
    assert (r["first"], r["last"], r.runs) == (DAY, DAY + dt.timedelta(minutes=20), 3)


def test_linking_never_guesses(spark):
    products = spark.createDataFrame([(1, "Молоко Простоквашино 2,5% 930мл", None, None), (2, "Кефир 1% 900г", None, None), (3, "Что угодно", "4607084350029", None), (4, "МОЛ.ПРОСТ. 2,5% 930мл", None, None)], "product_id long, name string, barcode string, weight_g double")
    items = spark.createDataFrame([(100, "Молоко Простоквашино 2,5 % 930 мл", None), (200, "Кефир 1% 900г", None), (201, "Кефир 1 % 900 г", None), (300, "Чай", None)], "item_id long, name string, weight_g double")
    skus = spark.createDataFrame([("s", 300, "04607084350029")], "sku string, item_id long, gtin string")
    bridge = spark.createDataFrame([], "product_id long, sku string")
    got = {r.product_id: (r.item_id, r.method) for r in link.find_master(products, items, skus, bridge).collect()}
    assert got == {1: (100, "words"), 2: (None, "doubtful"), 3: (300, "barcode"), 4: (100, "abbreviation")}
