from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from basketry.sources import files, pages
from basketry.streaming import observations


def test_price_list_with_and_without_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Название;Цена\nСыр;1 234,50\nПусто;\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Чай\t99,9\nКофе\t10\n", encoding="utf-8")
    assert [tuple(r) for r in files.price_list(spark, str(tmp_path / "a.csv")).collect()] == [("Сыр", 1234.5)]
    assert sorted(tuple(r) for r in files.price_list(spark, str(tmp_path / "b.csv")).collect()) == [("Кофе", 10.0), ("Чай", 99.9)]


def test_receipt_bundle_is_put_right_by_a_hundred(spark):
    doc = {"catalogue": [{"key": "k", "date": "2024-05-01", "store": "s", "total": "150.00"}], "receipts": [{"key": "k", "fiscalData": {"items": [{"name": "Чай", "quantity": 1, "price": "1.00", "sum": "1.00"}, {"name": "Сыр", "quantity": 2, "price": "0.25", "sum": "0.50"}]}}]}
    rows = files.receipt_bundle(spark.createDataFrame([(json.dumps(doc),)], "value string")).orderBy("position").collect()
    assert [(r.name, r.price, r.total, r.date) for r in rows] == [("Чай", 100.0, 100.0, dt.date(2024, 5, 1)), ("Сыр", 25.0, 50.0, dt.date(2024, 5, 1))]


def test_receipt_text_and_pasted_orders(spark):
    text = "Магазин\nХлеб белый 2 x 30,00 = 60,00\nСыр 0,5 x 400.00 = 200.00\nИТОГО: 260,00"
    rows = files.receipt_lines(spark.createDataFrame([(1, text)], "key int, text string")).orderBy("position").collect()
    assert [(r.name, r.qty, r.price, r.total, r.declared) for r in rows] == [("Хлеб белый", 2.0, 30.0, 60.0, 260.0), ("Сыр", 0.5, 400.0, 200.0, 260.0)]
    order = "Молоко\nдомашнее\n2 шт 99,90 ₽\nСыр\n300 ₽\nхвост"
    rows = files.pasted_orders(spark.createDataFrame([(1, order)], "key int, text string"), "key").orderBy("position").collect()
    assert [(r.name, r.qty, r.price) for r in rows] == [("Молоко домашнее", 2.0, 99.9), ("Сыр", 1.0, 300.0)]
    rows = files.pasted_lines(spark.createDataFrame([(1, "Чай; 2; 10,5\nКофе;7\nСок 55 руб\nнепонятно")], "key int, text string")).orderBy("position").collect()
    assert [(r.name, r.qty, r.price, r.ok) for r in rows] == [("Чай", 2.0, 10.5, True), ("Кофе", 1.0, 7.0, True), ("Сок", 1.0, 55.0, True), ("непонятно", 1.0, None, False)]


def test_price_bundle_counts_what_it_skips(spark):
    items = [{"sku": "1", "name": "a", "price": "10"}, {"sku": "1", "name": "b", "price": "11"}, {"sku": "", "name": "c", "price": "1"}, {"sku": "2", "name": "d", "price": "0"}]
    rows = files.price_bundle(spark.createDataFrame([(json.dumps({"items": items}),)], "value string")).orderBy("position").collect()
    assert [r.skipped for r in rows] == [None, "repeated", "no sku", "no price"]


def test_pages(spark):
    html = '<html><title> A  b </title><script type="application/ld+json">{"@type":"Product","name":"Чай","sku":"7","offers":{"price":"12,5","availability":"https://schema.org/InStock"}}</script></html>'
    r = pages.product_in_ld(spark.createDataFrame([(html,)], "html string")).first()
    assert (r.name, r.sku, r.price, r.in_stock) == ("Чай", "7", 12.5, True)
    df = spark.createDataFrame([("https://www.shop.ru/p/maslo-72-5-500g-123",), ("https://evil.ru/p/x-1",)], "url string")
    rules = [("shop.ru", r"-(\d+)$")]
    assert [r[0] for r in df.select(pages.sku_of(F.col("url"), rules)).collect()] == ["123", None]
    card = df.limit(1).select(pages.card_text(F.lit("-20% Новинка Сыр мягкий 1 299,90 ₽ 1 599 ₽")).alias("c")).first().c
    assert (card.name, card.price, card.old_price) == ("Сыр мягкий", 1299.9, 1599.0)
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d")], "id int, parent int, name string")
    assert sorted((r.id, r.path) for r in pages.category_leaves(tree).collect()) == [(3, ["a", "c"]), (4, ["a", "b", "d"])]


def test_cart_total_window(spark):
    lines = [(1, i, x) for i, x in enumerate(["Скидка 5 ₽", *["строка"] * 13, "Доставка 99 ₽", "Итого 1 234,50 ₽", "Скидка 10 ₽"])]
    r = pages.cart_total(spark.createDataFrame(lines, "cart int, position int, line string"), "cart").first()
    assert (r.total, r.delivery, r.discount) == (1234.5, 99.0, 10.0)


def test_stream_of_changes(spark, tmp_path):
    start = dt.datetime(2024, 5, 1)
    schema = "chain string, sku string, price double, seen_at timestamp"
    for n, rows in enumerate([[(10.0, 0), (10.0, 1), (12.0, 2)], [(12.0, 3), (9.0, 1), (15.0, 4)]]):
        spark.createDataFrame([("m", "1", p, start + dt.timedelta(days=d)) for p, d in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = observations.change_stream(stream, "12 hours").writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.seen_at, r.price, r.previous) for r in observations.change_table(spark.table("changes")).collect())
    assert [(p, b) for _, p, b in got] == [(10.0, None), (12.0, 10.0), (15.0, 12.0)]
    assert [(r.price, r.seen_at) for r in spark.table("changes").filter("op = 'late'").collect()] == [(9.0, start + dt.timedelta(days=1))]


def test_upsert_sink_starts_empty(spark, tmp_path):
    schema = "chain string, sku string, name string, weight_g double, category string, brand string, unit string, url string, image string, barcode string, price double, in_stock boolean"
    spark.createDataFrame([("m", "1", "Чай", None, None, None, None, None, None, None, 5.0, True, False)], schema + ", price_from_base boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", price_from_base boolean").parquet(str(tmp_path / "in"))
    observations.upsert_sink(stream, str(tmp_path / "snap"), str(tmp_path / "cp"), F.lit(dt.datetime(2024, 5, 1))).awaitTermination(120)
    assert [(r.sku, r.price, r.active) for r in observations.read_catalog(spark, str(tmp_path / "snap")).collect()] == [("1", 5.0, True)]


def test_receipt_headers_by_part(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Дата чека;Магазин;Наименование товара;Кол-во, шт;Цена за шт;Стоимость\n05.01.2026;Лавка;Сыр;2;10,50;21,00\n", encoding="utf-8")
    (row,) = files.receipt_table(spark, str(tmp_path / "r.csv")).collect()
    assert (str(row.date), row.store, row["name"], row.qty, row.price, row.total) == ("2026-01-05", "Лавка", "Сыр", 2.0, 10.5, 21.0)
