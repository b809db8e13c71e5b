from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from basketry.operators import carts, compare, device, dictionary, habits, health, history, link, market, matching, optimise, receipts, resolve
from basketry.sources import files, pages
from basketry.streaming import observations

DAY = dt.datetime(2024, 5, 1)
HOUR = dt.timedelta(hours=1)


def test_pages_and_apis(spark):
    xml = spark.createDataFrame([("<urlset><url><loc> https://a/p/1 </loc></url><url><loc>https://a/c/2</loc></url></urlset>",)], "value string")
    assert [r.url for r in pages.sitemap_locations(xml, pick="/p/").collect()] == ["https://a/p/1"]
    raw = spark.createDataFrame([(json.dumps({"id": "7", "title": "Чай", "prices": {"sale": 0, "full": 9.5}}),)], "value string")
    r = pages.api_products(raw, "struct<id:string,title:string,prices:struct<sale:double,full:double>>", {"sku": "id", "name": "title"}, ["prices.sale", "prices.full"]).first()
    assert (r.sku, r.name, r.price) == ("7", "Чай", 9.5)
    words = spark.createDataFrame([("Сыр за 99,90 ₽",), ("скидка 15 %",), ("минус 50 руб",)], "t string")
    got = [tuple(r[0]) for r in words.select(pages.coupon_terms(F.col("t"))).collect()]
    assert got == [(99.9, None, None), (None, 15.0, None), (None, None, 50.0)]


def test_receipt_table_and_reference_prices(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Дата;Магазин;Товар;Количество;Цена;Сумма\n01.05.2024;a;Сыр;2;;10,00\n2024-05-02;a;Чай;;7,5;\n", encoding="utf-8")
    got = [tuple(r) for r in files.receipt_table(spark, str(tmp_path / "r.csv")).orderBy("date").collect()]
    assert got == [(dt.date(2024, 5, 1), "a", "Сыр", 2.0, 5.0, 10.0), (dt.date(2024, 5, 2), "a", "Чай", 1.0, 7.5, 7.5)]
    (tmp_path / "p.csv").write_text("store_code,sku,name,price,unit,weight_g,price_per_kg,in_stock\na,1,Чай,\"9,5\",pcs,100,,да\na,2,Сыр,10,pcs,,,0\n", encoding="utf-8")
    got = files.reference_prices(spark, str(tmp_path / "p.csv")).orderBy("sku").collect()
    assert [(r.price, r.weight_g, r.in_stock) for r in got] == [(9.5, 100.0, True), (10.0, None, False)]
    mark = spark.createDataFrame([(dt.date(2024, 5, 1), "a", 10.0, ["x", "y"])], "d date, s string, t double, n array<string>")
    assert len(mark.select(files.fingerprint(*[F.col(c) for c in "dstn"])).first()[0]) == 16


def test_quantities_and_recipes(spark):
    items = spark.createDataFrame([(1, 10, 1.0, "pcs"), (1, 11, 0.4, "kg"), (1, 12, 2.0, "pcs")], "basket_id long, product_id long, qty double, unit string")
    new = spark.createDataFrame([(1, 10, 2.5, "pcs"), (1, 12, 0.0, "pcs"), (1, 13, 0.2, "pcs")], "basket_id long, product_id long, qty double, unit string")
    assert {r.product_id: r.qty for r in habits.set_quantities(items, new).collect()} == {10: 3.0, 11: 0.4, 13: 1.0}
    h = spark.createDataFrame([(1, p, DAY.date() + dt.timedelta(days=d), 1.0) for p, d in [(5, 0), (5, 7), (5, 14), (6, 14)]], "shopper long, product long, day date, qty double")
    today = F.lit(DAY.date() + dt.timedelta(days=22))
    assert {r["product"] for r in habits.basket_from_history(h, "usual", today).collect()} == {5}
    assert {r["product"] for r in habits.basket_from_history(h, "last", today).collect()} == {5, 6}
    assert {r["product"]: r.qty for r in habits.basket_from_history(h, "month", today).collect()} == {5: 3.0, 6: 1.0}


def test_devices(spark):
    r = spark.createDataFrame([(None, None, 90.0, 9.0), (50.0, 60.0, 1.0, None), (None, -1.0, None, None)], "to_pay double, total double, goods double, delivery double")
    assert [x.network_total for x in device.network_total(r).collect()] == [99.0, 50.0, None]
    schema = "chain string, address string, point string, at timestamp"
    a, b = spark.createDataFrame([("m", "Ул.  Мира 1", "p1", DAY)], schema), spark.createDataFrame([("m", "ул. мира 1", "p2", DAY + HOUR)], schema)
    assert [x.point for x in device.remember_points(a, b).collect()] == ["p2"]
    bundle = files.price_bundle(spark.createDataFrame([(json.dumps({"items": [{"sku": "1", "name": "a", "price": "10"}]}),)], "value string"))
    products, prices = device.import_prices(bundle, "s", F.lit(DAY))
    assert products.first().sku == "1" and prices.first().price == 10.0
    moved = spark.createDataFrame([("m", DAY, DAY + HOUR), ("x", DAY, DAY + HOUR), ("m", None, DAY)], "chain string, f timestamp, m timestamp")
    assert [x[0] for x in moved.select(device.before_move(F.col("f"), F.col("m"), F.col("chain"), ["m"])).collect()] == [True, False, False]
    per = spark.createDataFrame([("m", "1"), ("m", "m-7"), ("m", "9")], "chain string, sku string")
    kept, lost = device.mirror(per, per.filter("sku = '1'"))
    assert kept.count() == 1 and lost.first()["count"] == 1
    old = spark.createDataFrame([(DAY, 50.0, 200.0, "kg"), (DAY + 48 * HOUR, 50.0, 200.0, "kg")], "first_seen timestamp, price double, weight_g double, unit string")
    assert sorted(x.price for x in device.portion_to_kilo(old, F.lit(DAY + HOUR)).collect()) == [50.0, 250.0]


def test_health(spark):
    runs = spark.createDataFrame([(1, "m", "ok", DAY, DAY + HOUR), (2, "m", "failed", DAY, DAY), (3, "l", "ok", DAY, DAY + 2 * HOUR)], "id int, chain string, status string, started_at timestamp, finished_at timestamp")
    assert {r.chain: r.minutes for r in health.chain_minutes(runs).collect()} == {"m": 60.0, "l": 120.0}
    cat = spark.createDataFrame([("m", True, 1.0, DAY, True, 1, DAY, DAY + HOUR), ("m", True, None, None, None, None, DAY, DAY + 9 * HOUR)], "chain string, active boolean, price double, price_seen timestamp, in_stock boolean, item_id int, first_seen timestamp, last_seen timestamp")
    s = health.snapshot(cat, F.lit(DAY + HOUR)).first()
    assert (s.rows, s.priced, s.fresh, s.stocked, s.matched) == (2, 0.5, 0.5, 0.5, 0.5)
    assert {r.kind for r in health.device_rows(cat, F.lit(DAY), F.lit(DAY + 2 * HOUR)).collect()} == {"new"}
    marks = spark.createDataFrame([("k", DAY, '{"a": 1}'), ("k", DAY + HOUR, '{"a": 2}')], "key string, at timestamp, value string")
    assert health.latest_marks(marks).select(F.try_variant_get("value", "$.a", "int")).first()[0] == 2
    sweeps = spark.createDataFrame([("a", DAY, None, None), ("b", DAY, DAY, DAY), ("c", DAY, DAY + 20 * HOUR, None)], "name string, started_at timestamp, beat_at timestamp, finished_at timestamp")
    assert [r.state for r in health.sweep_state(sweeps, F.lit(DAY + 24 * HOUR)).orderBy("name").collect()] == ["stopped", "done", "running"]
    touched = history.touch_seen(cat.withColumn("sku", F.lit("1")).limit(1), spark.createDataFrame([("m", "1"), ("m", "2")], "chain string, sku string"), F.lit(DAY + 5 * HOUR))
    assert touched.first().last_seen == DAY + 5 * HOUR and touched.count() == 1
    rows = spark.createDataFrame([(False, None, 5), (False, 6, 7), (True, 8, None)], "active boolean, item_id int, prev_item_id int")
    assert sorted(r.item_id for r in history.sleeping(rows).collect()) == [5, 6]


def test_matching_reports(spark):
    m = spark.createDataFrame([("Кефир 1% 900 г", 900.0, "Кефир 2,5% 900 г", None, False), ("Чай", None, "Чай", None, False), ("Хлеб", None, "Гвозди", None, True)], "name string, weight_g double, other string, other_weight_g double, from_base boolean")
    assert [(r.name, r.doubts) for r in matching.doubts_report(m).collect()] == [("Кефир 1% 900 г", ["percent"])]
    w = spark.createDataFrame([(None, 0.1), (True, 0.1), (False, 0.0), (False, 0.3), (False, 0.6)], "c boolean, s double")
    assert [r[0] for r in w.select(matching.worth(F.coalesce("c", F.lit(False)), F.col("s"))).collect()] == [False, True, True, False, True]
    found = spark.createDataFrame([("Молоко пастеризованное 930 мл", 100.0, "pcs", None), ("Пюре", 50.0, "pcs", None)], "name string, price double, unit string, weight_g double")
    assert [(r.name, r.per_unit) for r in compare.compare_query("молоко", found).collect()] == [("Молоко пастеризованное 930 мл", 107.53)]


def test_baskets(spark):
    items = spark.createDataFrame([(1, 10, 2.0, False, None)], "basket_id long, product_id long, qty double, weighed boolean, ref_g double")
    prices = spark.createDataFrame([(10, s, v, None, "pcs", None, True, False, False) for s, v in [("a", 10.0), ("b", 11.0), ("c", 900.0)]], "product_id long, store string, price double, per_kg double, shop_unit string, pack_g double, in_stock boolean, portions boolean, by_weight boolean")
    lines = compare.basket_lines(items, prices)
    assert {r.store: r.value for r in lines.collect()} == {"a": 20.0, "b": 22.0}
    raw = spark.createDataFrame([(1, 10, s, v) for s, v in [("a", 20.0), ("b", 22.0), ("c", 1800.0)]], "basket_id long, product_id long, store string, value double")
    assert {r.store for r in optimise.drop_implausible(raw).collect()} == {"a", "b"}
    stores = spark.createDataFrame([("a", "LINK"), ("b", "PHONE")], "store string, handover string")
    assert [r.store for r in compare.effortless(stores).collect()] == ["a"]
    have, unknown = carts.plan(lines, spark.createDataFrame([(10, "a", "s")], "product_id long, store string, sku string"))
    assert have.first().sku == "s" and unknown.first().store == "b"
    two = items.union(items.withColumn("product_id", F.lit(11)))
    assert carts.stamp(two).first().stamp == carts.stamp(two.orderBy(F.desc("product_id"))).first().stamp != carts.stamp(items).first().stamp
    coupons = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 12, 1))], "coupon_id int, valid_to date")
    merged = carts.merge_coupons(coupons, spark.createDataFrame([(3, dt.date(2024, 12, 1))], "coupon_id int, valid_to date"), F.lit(DAY.date()))
    assert sorted(r.coupon_id for r in merged.collect()) == [1, 3]


def test_lists(spark):
    v = spark.createDataFrame([(1, "sir lamber"), (1, "sir"), (2, "cai")], "item_id long, folded string")
    items = spark.createDataFrame([(1,)], "item_id long")
    assert [r.folded for r in dictionary.search_variants(v, items, "сыр ламбер", 5).collect()] == ["sir lamber", "sir"]
    own = spark.createDataFrame([(1, "http://a/1.png"), (2, "local.png"), (3, None)], "product_id long, image string")
    rows = spark.createDataFrame([(2, "m", "1", "https://b/2.png"), (2, "a", "9", "https://b/9.png"), (3, "m", "1", "x")], "product_id long, chain string, sku string, image string")
    assert {r.product_id: r.image for r in dictionary.photos(own, rows).collect()} == {1: "http://a/1.png", 2: "https://b/9.png", 3: None}
    h = spark.createDataFrame([(1, "ХЛЕБ", dt.date(2024, 5, 1), 1), (1, "СЫР МЯГКИЙ", dt.date(2024, 5, 2), 2)], "product_id long, raw_name string, day date, id int")
    assert dictionary.human_titles(h).first().title == "Сыр мягкий"
    m = spark.createDataFrame([(1, "master", False), (2, "human", True)], "id int, method string, confirmed boolean")
    left, base = dictionary.without_base(m)
    assert (left.first().id, base.first().id) == (2, 1)
    p = spark.createDataFrame([("m", "1", DAY, 5.0), ("m", "1", DAY - 2400 * HOUR, 4.0)], "chain string, sku string, seen_at timestamp, price double")
    mp = spark.createDataFrame([(7, "m", "1")], "product_id long, chain string, sku string")
    assert [r.price for r in dictionary.price_history(p, mp, 30, F.lit(DAY)).collect()] == [5.0]
    assert receipts.count_by_store(spark.createDataFrame([("a",), ("b",), ("a",)], "store string")).first()["count"] == 2
    old = spark.createDataFrame([(1, "m", "x", DAY, DAY, 3), (2, "m", "y", DAY, DAY + HOUR, 5)], "item_id long, chain string, variant string, first_seen timestamp, last_seen timestamp, hits long")
    new = spark.createDataFrame([(1, "m", "x", DAY + HOUR), (2, "m", "y", DAY), (3, "m", "z", DAY)], "item_id long, chain string, variant string, seen timestamp")
    assert {r.item_id: r.hits for r in receipts.name_variants(new, old).collect()} == {1: 4, 2: 5, 3: 1}


def test_unique_words_and_nearest(spark):
    schema = "id long, fwords array<string>"
    rows = spark.createDataFrame([(1, ["kefir", "domik", "moloko"]), (2, ["kefir", "prostokvasino"]), (3, ["cai"])], schema)
    wanted = spark.createDataFrame([(10, ["kefir", "domik"]), (11, ["kefir"]), (12, ["sahar"])], schema)
    assert {r.wanted_id: r.id for r in link.unique_by_words(wanted, rows).collect()} == {10: 1}
    pts = spark.createDataFrame([("m", "far", 55.9, 37.6, "EC"), ("m", "near", 55.751, 37.62, "SM"), ("m", "hyper", 55.76, 37.62, "HM")], "chain string, point string, lat double, lon double, format string")
    at = (F.lit(55.75), F.lit(37.62))
    assert [r.point for r in market.nearest(pts, *at, ["chain"], within_km=5).collect()] == ["near"]
    kind = F.when(F.col("format") == "HM", 0).when(F.col("format") == "SM", 1).otherwise(2)
    assert [r.point for r in market.nearest(pts, *at, ["chain"], kind, 2).orderBy("rank").collect()] == ["hyper", "near"]
    cat = resolve.prepare(spark.createDataFrame([(1, "a", "syr lamber 200g", None, None, "pcs", None), (2, "b", "Сыр Ламбер полутвёрдый 200 г", None, None, "pcs", None)], "id long, chain string, name string, brand string, weight_g double, unit string, barcode string"))
    one = resolve.canonical(cat, spark.createDataFrame([(1, 1), (2, 1)], "id long, item long")).first()
    assert one.name.startswith("Сыр") and (one.rows, one.chains) == (2, 2)


def test_streams_by_window(spark, tmp_path):
    rows = [("m", "1", 10.0, DAY), ("m", "1", 10.0, DAY), ("m", "1", 30.0, DAY + HOUR), ("m", "1", 5.0, DAY + 90 * HOUR)]
    schema = "chain string, sku string, price double, seen_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("once", observations.deduplicated(read())), ("days", observations.windowed_prices(read()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("once").count() == 3
    assert [(r.low, r.high, r.n) for r in spark.table("days").collect()] == [(10.0, 30.0, 3)]
