from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from basketry.functions import conflicts as c
from basketry.functions.titles import human_name, shown_name
from basketry.operators import carts, compare, device, dictionary, matching, receipts, resolve, search
from basketry.sources import files

DAY = dt.datetime(2024, 5, 1)
PAIR = "product_id long, store string, sku string, name string, barcode string, weight_g double, other string, other_barcode string, other_weight_g double"


def test_conflicts_need_both_sides(spark):
    rows = [("Страчателла 200 г", "Мороженое Страчателла 92 г"), ("Дезодорант Axe Ice", "Антиперспирант Rexona 40 мл"), ("Кефир 1%", "Кефир 2,5 %"), ("Хлеб", "Булочка с маком")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string").orderBy("i")
    got = df.select(c.doubts(F.col("a"), F.lit(None).cast("double"), F.col("b"), F.lit(None).cast("double"))).collect()
    assert [r[0] for r in got] == [["type"], ["brand"], ["percent"], []]


def test_candidates_and_auto_match(spark):
    rows = [
        (1, "a", "s1", "Молоко Домик 2,5% 930 мл", None, 930.0, "Молоко Домик 2,5% 930мл", None, None), (1, "a", "s2", "Молоко Домик 2,5% 930 мл", None, 930.0, "Молоко Домик 3,2% 930мл", None, None),
        (2, "a", "s3", "Чай", "1", None, "Совсем другое", "1", None), (3, "a", "s4", "Кофе Jacobs 95 г", None, 95.0, "Кофе Jacobs 190 г", None, 190.0), (4, "a", "s5", "Сыр", None, None, "Сыр", None, None),
    ]
    pairs = spark.createDataFrame(rows, PAIR)
    scores = {r.sku: r.score for r in matching.scored(pairs).collect()}
    assert scores["s1"] > 0.9 and scores["s2"] == 0.0 and scores["s3"] == 1.0 and scores["s4"] <= 0.5
    none = spark.createDataFrame([], PAIR)
    got = matching.auto_match(pairs, none, pairs.filter("sku = 's3'")).collect()
    assert {r.sku for r in got} == {"s1"}
    assert matching.auto_match(pairs, pairs.filter("product_id = 1"), none).count() == 1


def test_find_in_chain_reasons(spark):
    asked = spark.createDataFrame([(1, "Молоко Parmalat 1,8% 1 л", 1000.0), (2, "Молоко Parmalat 1,8% 1 л", 1000.0), (3, "Чай", None), (4, "Кофе Jacobs Gold 95 г", 95.0)], "id long, name string, pack_g double")
    found = spark.createDataFrame([(1, "a", "Молоко Parmalat 1,8% 1л", None, 99.0, 0.7), (1, "b", "Молоко Parmalat 3,5% 200мл", None, 50.0, 0.9), (2, "c", "Молоко Parmalat 3,5% 200мл", None, 50.0, 0.9), (4, "d", "Кофе Jacobs Монарх 95 г", None, 9.0, 0.6)], "id long, sku string, other string, other_pack_g double, price double, score double")
    got = {r.id: r for r in matching.find_in_chain(asked, found).collect()}
    assert (got[1].ok, got[1].sku, got[1].reason) == (True, "a", "found")
    assert not got[2].ok and got[2].reason == "other" and "percent" in got[2].difference and got[2].confidence <= 0.4
    assert (got[3].sku, got[3].reason) == (None, "none") and got[4].reason == "alike"


def test_search_terms_and_fallback(spark):
    df = spark.createDataFrame([("Молоко отборное Parmalat 1,8% 1 л",)], "name string")
    assert df.select(matching.search_terms(F.col("name"), F.lit(1000.0))).first()[0] == ["молоко отборное parmalat", "parmalat 1.8", "parmalat 1000", "parmalat"]
    prices = spark.createDataFrame([("1", "Молоко пастеризованное", 90.0), ("2", "Молочный коктейль", 80.0), ("3", "Гвозди", 1.0)], "sku string, name string, price double")
    got = matching.fallback_search(spark.createDataFrame([(1, "молоко")], "id int, name string"), prices, 3).orderBy("rank").collect()
    assert [r.sku for r in got][:1] == ["1"] and "3" not in {r.sku for r in got}


def test_relevance(spark):
    def about(q, n, score):
        row = spark.createDataFrame([(q, n, score)], "q string, n string, s double")
        from basketry.functions.text import ordered_words as w

        return row.select(search.relevant(w(F.col("q")), w(F.col("n")), F.col("s"), F.lit(True))).first()[0]

    assert about("молоко", "Молоко пастеризованное 930 мл", 0.2)
    assert not about("молоко козье", "Молоко", 0.9)
    assert not about("огурцы", "Пюре яблочное", 0.3)


def test_readable_titles(spark):
    lines = ["САРАФ.Мор.ЗЕФ.эск.ван.гл.8% 75г", "Молоко Домик в деревне 2,5% 930 мл", "ХЛЕБ БЕЛЫЙ", None, "shop.ru заказ", "ТЁМА Биойог.дет.бан/зем. 2.8% 210г", "Колб.вар.дет. с сыр. 300г"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "raw string").select(human_name(F.col("raw"))).collect()]
    assert got == [
        "Сараф. Мороженое зефир эскимо ванильное глазированное 8% 75 г", "Молоко Домик в деревне 2,5% 930 мл", "Хлеб белый", "", "shop.ru заказ",
        "Тёма Биойогурт детский банан/земляника 2,8% 210 г", "Колбаса варёная детская с сыр. 300 г",
    ]
    pair = spark.createDataFrame([("сыр косичка 150 г", "Сыр КОСИЧКА 150г"), ("Мой сыр", "Сыр КОСИЧКА 150г"), ("", "ЧАЙ")], "name string, raw string")
    assert [r[0] for r in pair.select(shown_name(F.col("name"), F.col("raw"))).collect()] == ["Сыр КОСИЧКА 150 г", "Мой сыр", "Чай"]


def test_comparison_table(spark):
    products, stores = spark.createDataFrame([(1,)], "product_id long"), spark.createDataFrame([("a",), ("b",), ("c",)], "store string")
    maps = spark.createDataFrame([(1, "a", "x", "pcs", 930.0), (1, "b", "y", "pcs", 1000.0)], "product_id long, store string, sku string, unit string, weight_g double")
    prices = spark.createDataFrame([("a", "x", 149.0, True)], "store string, sku string, price double, in_stock boolean")
    got = {r.store: (r.per_unit, r.note) for r in compare.compare_products(products, stores, maps, prices).collect()}
    assert got == {"a": (160.22, None), "b": (None, "no fresh price"), "c": (None, "not mapped")}


def test_resolve_description(spark):
    schema = "id long, chain string, name string, brand string, weight_g double, unit string, barcode string"
    rows = resolve.prepare(spark.createDataFrame([(1, "a", "Сметана Кружка 15% 300г", None, None, "pcs", None), (2, "b", "Сметана Кружка 20% 300г", None, None, "pcs", None)], schema))
    asked = resolve.prepare(spark.createDataFrame([(9, "me", "Сметана Кружка 20 % 300 г", None, None, "pcs", None)], schema))
    assert [(r.asked_id, r.id) for r in compare.resolve_description(asked, rows).collect()] == [(9, 2)]


def test_device_reports(spark):
    doc = {"chain": "m", "basket": "b", "at": "2024-05-01T00:00:00", "lines": [
        {"sku": "1", "price": 10.0, "landed": True}, {"sku": "2", "price": 20.0, "landed": False, "words": "Нет в наличии"},
        {"sku": "m-3", "price": 1.0}, {"price": 5.0}, {"sku": "4", "price": 7.0, "own_card": True, "in_stock": True}]}
    lines = device.report_lines(spark.createDataFrame([(json.dumps(doc),)], "value string")).orderBy("position").cache()
    assert [(r.rejected, r.stock, r.named_price) for r in lines.collect()] == [(None, True, 10.0), (None, False, None), ("placeholder", None, None), ("no sku", None, None), (None, True, 7.0)]
    cat = spark.createDataFrame([("m", "1", True, 9.0, None, True, DAY), ("m", "2", True, 9.0, DAY, False, DAY)], "chain string, sku string, in_stock boolean, price double, price_seen timestamp, active boolean, last_seen timestamp")
    assert [r.sku for r in device.learn_rows(cat, lines).collect()] == ["4"]
    at = F.lit(DAY + dt.timedelta(days=1))
    got = {r.sku: (r.in_stock, r.price, r.active) for r in device.set_values(cat, lines.filter("rejected is null"), at).collect()}
    assert got == {"1": (True, 10.0, True), "2": (True, 9.0, False)}
    got = {r.sku: (r.in_stock, r.active) for r in device.set_values(cat, lines.filter("rejected is null"), at, revive=True).collect()}
    assert got == {"1": (True, True), "2": (False, True)}


def test_migrations(spark):
    p = spark.createDataFrame([(1, "Бананы", "kg", None), (2, "Лимон", "kg", None), (3, "Чай 100г", None, None)], "product_id long, name string, unit string, weight_g double")
    w = spark.createDataFrame([(1, True), (2, False)], "product_id long, weighed boolean")
    assert {r.product_id: r.unit for r in device.false_kilos(p, w, w.limit(0)).collect()} == {1: "kg", 2: "pcs", 3: None}
    assert {r.product_id: (r.unit, r.weight_g) for r in device.fill_sizes(p).collect()}[3] == ("pcs", 100.0)
    skus = spark.createDataFrame([("x-preview-1",), ("7",)], "sku string")
    left, kids = device.without_ghosts(skus, [skus.withColumn("price", F.lit(1.0))])
    assert [r.sku for r in left.collect()] == ["7"] == [r.sku for r in kids[0].collect()]


def test_dictionary(spark):
    m = spark.createDataFrame([(1, "Сыр Ламбер", DAY)], "item_id long, seen_name string, at timestamp")
    h = spark.createDataFrame([(1, "СЫР ЛАМБЕР", DAY), (2, "Чай", DAY)], "item_id long, raw_name string, at timestamp")
    assert {(r.item_id, r.folded): r.hits for r in dictionary.receipt_variants(m, h).collect()} == {(1, "lamber"): 2, (2, "cai"): 1}
    r = spark.createDataFrame([(1, "ВОДА С/ГАЗ 1л"), (1, "ВОДА Н/ГАЗ 1л"), (2, "ЧАЙ 100г")], "product_id long, raw_name string")
    assert [x.product_id for x in dictionary.contradicting(r).collect()] == [1]
    docs = dictionary.workspace_document(spark.createDataFrame([("w",)], "workspace string"), spark.createDataFrame([("w", 1)], "workspace string, basket_id int"), spark.createDataFrame([(1, 7, 2.0)], "basket_id int, product_id int, qty double"))
    assert json.loads(docs.first().document) == {"workspace": "w", "baskets": [{"basket_id": 1, "lines": [{"product_id": 7, "qty": 2.0}]}]}


def test_weighed_by_evidence(spark):
    p = spark.createDataFrame([(1, "Груша весовая"), (2, "Хлеб"), (3, "Рыба"), (4, "Тайна"), (5, "Яйцо 10шт")], "product_id long, name string")
    h = spark.createDataFrame([(2, 1.0), (2, 2.0), (3, 0.345), (3, 1.0)], "product_id long, qty double")
    rows = spark.createDataFrame([(4, "pcs"), (4, "pcs")], "product_id long, unit string")
    assert {r.product_id: r.weighed for r in carts.weighed_products(p, h, rows).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_price_list_is_read_again(spark, tmp_path):
    df = spark.createDataFrame([("Сыр", 1234.5), ("Чай", 9.9)], "name string, price double")
    device.save_price_list(df.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert sorted(map(tuple, files.price_list(spark, str(part)).collect())) == [("Сыр", 1234.5), ("Чай", 9.9)]


def test_receipt_states_and_steps(spark):
    rows = [("a", dt.date(2024, 5, 1), "imported"), ("b", dt.date(2024, 5, 9), "seen"), ("c", dt.date(2024, 5, 3), "unavailable")]
    df = spark.createDataFrame(rows, "key string, date date, state string")
    today = F.lit("2024-05-31").cast("date")
    assert receipts.stale_days(df, today).first().days == 30
    assert receipts.next_steps(df, today).first().steps == ["refresh", "fetch", "retry"]
    assert receipts.next_steps(df.limit(0), today).first().steps == ["load"]
    assert [r.key for r in receipts.with_state(df, "seen").collect()] == ["b"]


def test_phone_plan(spark):
    lines = spark.createDataFrame([(1, 10, "a", "Сыр Ламбер 400г", 0.7, "kg"), (1, 11, "a", "Доставка заказа", 1.0, "pcs"), (1, 12, "a", "Чай", 1.4, "pcs")], "basket_id long, product_id long, store string, name string, qty double, unit string")
    maps = spark.createDataFrame([(10, "a", "s", 400.0)], "product_id long, store string, sku string, pack_g double")
    got = {r.product_id: (r.sku, r.times) for r in carts.phone_plan(lines, maps).collect()}
    assert got == {10: ("s", 2), 12: (None, 2)}
    q = spark.createDataFrame([(1, "a", 10.0, None, None, None, ["b", "a"]), (1, "b", None, None, None, None, [])], "basket_id long, store string, total double, delivery double, service_fee double, discount double, missing array<string>")
    assert [(r.status, json.loads(r.quote)["missing"]) for r in carts.quotes(q).orderBy("store").collect()] == [("partial", ["a", "b"]), ("none", [])]


def test_rows_by_gtin(spark):
    cat = spark.createDataFrame([("m", "1", "4607084350029", True, None), ("l", "2", "0460 7084 350029", True, 5), ("l", "3", None, True, None)], "chain string, sku string, barcode string, active boolean, item_id long")
    codes = spark.createDataFrame([("04607084350029",)], "barcode string")
    assert sorted(r.sku for r in dictionary.rows_by_gtin(cat, codes).collect()) == ["1", "2"]
    assert {r.chain: r.unmatched for r in dictionary.unmatched(cat).collect()} == {"m": 1, "l": 1}
