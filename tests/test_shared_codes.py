from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from basketry.functions.similarity import connector_similarity, may_be_similar, ratio_bound, similarity
from basketry.operators import carts, link, matching
from basketry.operators.shared_codes import match_shared_codes, same_brand, same_stem, with_facts

PRODUCT = "product_id long, brand string, weight_g double, unit string"
NAME = "product_id long, name string, own boolean"
ROW = "sku string, name string, weight_g double, unit string"


def codes(spark, products, names, rows, brands=("Простоквашино", "Добрый", "Агуша", "Lays")):
    got = match_shared_codes(spark.createDataFrame(products, PRODUCT), spark.createDataFrame(names, NAME), spark.createDataFrame(rows, ROW), spark.createDataFrame([(b,) for b in brands], "brand string"))
    return {r.product_id: (r.sku, r.soft) for r in got.collect()}


def test_stems_and_brands(spark):
    df = spark.createDataFrame([("saha", "sahar"), ("moloko", "molocnii"), ("cai", "caini"), ("kefir", "kefira"), ("lais", "laisi"), ("dobrii", "dobraa"), ("dobri", "dobrii")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(same_stem(a, b), same_brand(a, b)).collect()] == [(True, False), (True, False), (False, False), (True, True), (True, False), (True, False), (True, True)]


def test_facts_of_names(spark):
    names = ["Вода без газа 0,5 л", "Вода газированная 1,5л", "voda 0 5l", "Пюре с 6 мес. 3 овоща 80 г", "Йогурт 4 шт 2 вкуса 125 г"]
    got = with_facts(spark.createDataFrame([(n, None, None) for n in names], "name string, weight_g double, unit string")).collect()
    assert [r.gas for r in got] == ["no", "yes", None, None, None]
    assert [r.weight_g for r in got] == [500.0, 1500.0, 500.0, 80.0, 125.0]
    assert [r.baby for r in got] == [False, False, False, True, False]
    assert [(r.packs, r.numbers) for r in got[3:]] == [(1, "3"), (4, "2")]


def test_shared_codes(spark):
    products = [(1, "Простоквашино", 930.0, "pcs"), (2, "Добрый", 1000.0, "pcs"), (3, None, 500.0, "pcs"), (4, "Агуша", 200.0, "pcs"), (5, "Lays", 140.0, "pcs"), (6, None, None, None)]
    names = [(1, "Кефир Простоквашино 930 г", True), (2, "Сок Добрый яблоко 1 л", True), (3, "Гвозди 500 г", True), (4, "Творог Агуша 200 г", True), (5, "Чипсы Lays сметана 140 г", True), (6, None, True)]
    rows = [
        ("k1", "kefir prostokvashino 930g", None, "pcs"), ("k2", "kefir prostokvashino 500g", None, "pcs"), ("k3", "ryazhenka prostokvashino 930g", None, "pcs"),
        ("j1", "Сок Добрый яблоко 1 л", None, "pcs"), ("j2", "Сок Добрый яблоко 1л", None, "pcs"), ("n1", "Гвозди 500 г", None, "pcs"), ("a1", "Творог Агуша 200 г", None, "pcs"),
        ("l1", "Чипсы Lays картофельные сметана 140 г", None, "pcs"), ("l2", "Чипсы Lays краб 140 г", None, "pcs"), ("x", None, None, None), ("x", "", None, None), (None, "Сок Добрый 1 л", None, "pcs"),
    ]
    got = codes(spark, products, names, rows)
    # 1 by spelling, not the other size or kind; 2 fits two codes; 3 has no brand; 5 only in the soft pass
    assert got == {1: ("k1", False), 4: ("a1", False), 5: ("l1", True)}
    assert codes(spark, products, names + names, rows + rows) == got
    assert codes(spark, products, names, []) == {}


def test_codes_contradictions(spark):
    products = [(i, "Добрый", None, "pcs") for i in range(1, 5)]
    names = [(1, "Вода Добрый с газом 1 л", True), (2, "Вода Добрый 6х1 л", True), (3, "Вода Добрый 1 л", True), (3, "Вода Добрый 2 л", False), (4, "Вода Добрый 7 трав 1 л", True)]
    rows = [("still", "Вода Добрый без газа 1 л", None, "pcs"), ("six", "Вода Добрый 6х1 л", None, "pcs"), ("herbs", "Вода Добрый 7 трав 1 л", None, "pcs"), ("two", "Вода Добрый 2 л", None, "pcs")]
    # 1 is with gas; 3 says 1 l by its own name, so the name of 2 l from another chain does not count
    assert codes(spark, products, names, rows) == {2: ("six", False), 3: ("still", False), 4: ("herbs", False)}


def test_unique_words_against_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    draw = lambda n: [(i, [w for w in rng.choices(words, weights=range(1, 13), k=rng.randint(0, 6))]) for i in range(n)]
    wanted, rows = draw(60), draw(80)
    schema = "id long, fwords array<string>"
    got = {r.wanted_id: r.id for r in link.unique_by_words(spark.createDataFrame(wanted, schema), spark.createDataFrame(rows, schema)).collect()}
    want = {}
    for i, a in wanted:
        hits = {j: len(set(a) & set(b)) for j, b in rows}
        most = max(hits.values())
        top = [j for j, h in hits.items() if h == most]
        if a and most and len(top) == 1 and most >= 0.6 * len(set(a)):
            want[i] = top[0]
    assert want and got == want


def test_bounds_lose_nothing(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("абв гдм олк") for _ in range(rng.randint(0, 14)))
    df = spark.createDataFrame([(text(), text()) for _ in range(300)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", ratio_bound(a, b).alias("bound"), may_be_similar(a, b, 0.8).alias("may"), similarity(a, b).alias("s")).collect():
        assert r.bound >= SequenceMatcher(None, r.a, r.b).ratio() - 1e-12 or not (r.a or r.b)
        assert r.may or r.s < 0.8


def test_fallback_against_all_pairs(spark):
    rng = random.Random(5)
    kinds = ["Молоко", "Кефир", "Молочный напиток", "Мёд", "Сок яблочный", "молоко топлёное", "", "Хлеб"]
    prices = spark.createDataFrame([(str(i), f"{rng.choice(kinds)} {rng.choice(kinds)}".strip(), float(i)) for i in range(60)] + [("n", None, 1.0)], "sku string, name string, price double")
    asked = spark.createDataFrame([(1, "молоко"), (2, "мед"), (3, "оз"), (4, None), (5, "сок яблочный"), (6, "  ")], "id int, name string")
    got = {(r.id, r.rank): (r.sku, round(r.score, 6)) for r in matching.fallback_search(asked, prices, 4).collect()}
    low = lambda c: F.replace(F.lower(F.trim(F.col(c))), F.lit("ё"), F.lit("е"))
    pairs = asked.filter("trim(name) <> ''").crossJoin(prices.withColumnRenamed("name", "other")).withColumn("score", connector_similarity(F.col("name"), F.col("other")))
    pairs = pairs.withColumn("score", F.when(F.contains(low("other"), low("name")), F.greatest("score", F.lit(0.95))).otherwise(F.col("score")))
    want = {}
    for i in (1, 2, 3, 5):
        best = sorted((-r.score, r.sku) for r in pairs.filter(F.col("id") == i).collect() if r.score >= 0.45)[:4]
        want |= {(i, n): (sku, round(-s, 6)) for n, (s, sku) in enumerate(best, 1)}
    assert len(want) >= 12 and got == want


def test_coupons_by_name(spark):
    prices = spark.createDataFrame([("a", "1", "Молоко Домик 2,5% 930 мл", 100.0), ("a", "2", "Хлеб белый", 50.0), ("b", "1", "Молоко Домик 2,5% 930 мл", 100.0), ("a", "3", None, 10.0)], "store string, sku string, name string, price double")
    coupons = spark.createDataFrame([("a", 1, "Молоко Домик 2,5% 930мл", None, 20.0, None), ("a", 2, "молоко домик 2,5% 930 мл", 90.0, None, None), ("a", 3, None, 1.0, None, None), ("b", 4, "Сыр", 1.0, None, None)], "store string, coupon_id int, product string, coupon_price double, percent double, off double")
    got = {(r.store, r.sku): (r.my_price, r.coupon_id) for r in carts.best_named_coupons(prices, coupons).collect()}
    assert got[("a", "1")] == (80.0, 1) and got[("a", "2")][0] == 50.0 and got[("b", "1")][0] == 100.0 and got[("a", "3")][0] == 10.0
