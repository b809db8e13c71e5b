"""Receipts nested in JSON documents of any shape."""

from __future__ import annotations

import datetime as dt
import json

from basketry.sources import files


def test_the_first_object_with_items_at_any_depth(spark):
    inner = {"items": [{"name": "Сыр", "quantity": 2, "price": 10050, "sum": 20100, "productCodeNew": {"ean13": {"gtin": "04607084350029"}}}, {"Name": "Чай", "Price": "99,90", "barcode": "12345670 x"}, {"sum": 300.0}, "junk", {"name": "без цены"}],
             "user": "ООО Ромашка", "dateTime": "2024-05-01T10:11:12", "totalSum": 32991}
    deep: object = {"ticket": inner}
    for _ in range(3000):
        deep = [deep]
    docs = [
        (1, json.dumps([{"id": 5, "items": []}, {"document": {"receipt": inner}}, {"items": [{"name": "later", "price": 1}]}], ensure_ascii=False)),
        (2, json.dumps({"items": [{"price": 5.5, "quantity": "3"}], "date": "01.06.2024 12:00"})),
        (3, "no json"), (4, None), (5, "{}"), (6, "[" * 400 + json.dumps({"ticket": inner}) + "]" * 400),
    ]
    got = {}
    for r in files.receipt_documents(spark.createDataFrame(docs, "id long, value string")).collect():
        got.setdefault(r.id, []).append(tuple(r)[1:])
    shop, day = "ООО Ромашка", dt.date(2024, 5, 1)
    want = [(day, shop, 329.91, 0, "Сыр", 2.0, 100.5, 201.0, "04607084350029"), (day, shop, 329.91, 1, "Чай", 1.0, 99.9, 99.9, "12345670"), (day, shop, 329.91, 2, shop, 1.0, 300.0, 300.0, None)]
    assert got[1] == want and got[6] == want
    assert got[2] == [(dt.date(2024, 6, 1), None, 16.5, 0, "Позиция без названия", 3.0, 5.5, 16.5, None)] and set(got) == {1, 2, 6}
    assert files._with_items(deep) is inner
    known = spark.createDataFrame([(json.dumps({"brand": "точка 7", "retailPlace": "ООО Ромашка Плюс", "items": [{"name": "a", "sum": 100}]}),)], "value string")
    assert files.receipt_documents(known, signs=[("ромашка", "m")]).first().store == "ООО Ромашка Плюс" and files.receipt_documents(known).first().store == "точка 7"
