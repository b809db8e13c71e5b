"""Documents of workspaces: temporary ids, deletes by absence, replays, malformed parts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from basketry.operators import workspace as ws

CATALOG = "item_id long, name string, brand string, weight_g double, unit string, category string"


@pytest.fixture(scope="module")
def around(spark):
    catalog = spark.createDataFrame([(5, "Сыр", "А", 200.0, "pcs", "сыры"), (6, None, None, None, "kg", None)], CATALOG)
    return {"catalog": catalog, "stores": spark.createDataFrame([(1,), (2,)], "store_id long"), "chains": spark.createDataFrame([("lenta",), ("dixy",)], "chain string"), "today": "2024-05-01"}


def sent(spark, *docs):
    return spark.createDataFrame([(w, v, d if isinstance(d, str | None) else json.dumps(d, ensure_ascii=False)) for w, v, d in docs], "workspace string, version long, document string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


FIRST = {
    "products": [{"id": -5, "name": "чужое"}, {"id": -6, "name": "Чай ABC"}, {"id": -9, "name": "чай"}, {"id": 40, "name": "Чай abc", "active": False}, {"id": -8}, {"id": -5, "name": "again"}, 7],
    "baskets": [{"id": -1, "name": " Неделя "}, {"id": 3, "source": "history", "created_at": "2024-01-02T03:04:05.678"}, {"id": "x"}, "junk"],
    "basketItems": {"-1": [{"product_id": -5, "qty": 2}, {"product_id": -5, "qty": "3"}, {"product_id": 99, "qty": 1}, {"product_id": 40, "qty": 0}, {"product_id": -6, "qty": 1, "fallback_product_id": 1}], "3": [{"product_id": 40, "qty": 1, "fallback_product_id": 77}], "z": [], "8": []},
    "lastBasketId": -1, "address": " ", "point": [55.1, 37.2], "applyBonuses": True, "storePerks": {"a": 1}, "repeated": 3,
    "cards": [{"id": -1, "bank": "Б"}, {"id": 7}], "offers": [{"card_id": -1, "store_id": 2, "percent": 5}, {"card_id": 7, "store_id": 9}, {"card_id": 4, "store_id": 1}],
    "connections": {"lenta": {"connected": True, "mode": "session"}, "other": {"connected": True}, "dixy": 1},
}


def test_made_up_ids_are_resolved_everywhere(spark, around):
    s = ws.apply_documents(ws.empty_state(spark), sent(spark, ("w", 1, FIRST), ("v", 1, {"baskets": [{"id": 0}]})), **around)
    assert rows(s["products"].filter("workspace = 'w'"), "product_id", "name", "unit", "active") == [(1, "Сыр", "pcs", True), (2, "Чай ABC", "kg", True), (3, "чай", "pcs", True), (4, "Чай abc", "pcs", False)]
    assert rows(s["baskets"], "workspace", "basket_id", "name", "created_at", "source") == [("v", 1, "Корзина", "2024-05-01", "manual"), ("w", 3, "Корзина", "2024-01-02T03:04:05", "history"), ("w", 4, "Неделя", "2024-05-01", "manual"), ("w", 5, "Корзина", "2024-05-01", "manual")]
    assert {tuple(r) for r in s["items"].collect()} == {("w", 4, 1, 3.0, None), ("w", 4, 2, 1.0, 1), ("w", 3, 4, 1.0, None)}
    assert rows(s["settings"], "name", "value") == [("applyBonuses", "1"), ("lastBasketId", "4"), ("point", "[55.1,37.2]"), ("storePerks", '{"a":1}')]
    assert rows(s["cards"], "card_id", "bank", "name") == [(7, "Банк", "Карта"), (8, "Б", "Карта")] and rows(s["offers"], "offer_id", "card_id", "store_id", "percent", "activated") == [(1, 8, 2, 5.0, True)]
    assert rows(s["connections"], "chain", "device") == [("lenta", True)]


def test_export_change_apply_export(spark, around):
    s = ws.apply_documents(ws.empty_state(spark), sent(spark, ("w", 1, FIRST)), **around)
    before = {r.workspace: json.loads(r.document) for r in ws.documents_of(s).collect()}
    again = ws.apply_documents(s, sent(spark, ("w", 2, before["w"])), **around)
    same = json.loads(ws.documents_of(again).first().document)
    for d in (same, before["w"]):  # offers are written anew and so numbered anew
        d["offers"] = [{k: v for k, v in o.items() if k != "id"} for o in d["offers"]]
    assert same == before["w"]
    doc = json.loads(json.dumps(same))
    doc["baskets"] = [{**b, "name": "Другая"} for b in doc["baskets"] if b["id"] == 4]
    doc["basketItems"]["4"] = [{"product_id": 3, "qty": 7.5}]
    doc["products"].append({"id": -5, "name": "Сыр"})
    doc["connections"]["lenta"]["connected"] = False
    after = ws.apply_documents(again, sent(spark, ("w", 3, doc)), **around)
    got = json.loads(ws.documents_of(after).first().document)
    assert got["baskets"] == [{"id": 4, "name": "Другая", "created_at": "2024-05-01", "source": "manual"}] and got["basketItems"] == {"4": [{"product_id": 3, "qty": 7.5}]}
    assert got["products"] == same["products"] and "connections" not in got and got["cards"] == same["cards"]


def test_a_replay_changes_nothing_and_order_counts(spark, around):
    batch = sent(spark, ("w", 2, {"baskets": [{"id": -1, "name": "b"}, {"id": 1, "name": "kept"}]}), ("w", 1, {"baskets": [{"id": -1, "name": "a"}]}), ("w", 2, {"baskets": []})).withColumn("value", F.lit("own"))
    s = ws.apply_documents(ws.empty_state(spark), batch.filter("document NOT LIKE '%[]%'"), **around)
    assert rows(s["baskets"], "basket_id", "name") == [(1, "kept"), (2, "b")] and rows(s["applied"], "workspace", "version") == [("w", 2)]
    t = ws.apply_documents(s, batch, **around)
    assert all(rows(s[n], *s[n].columns) == rows(t[n], *t[n].columns) for n in ("baskets", "applied"))


def test_odd_documents(spark, around):
    odd = [None, "", "[]", "no json", '{"baskets": 3, "basketItems": {"3": []}, "cards": [], "lastBasketId": "x", "point": 5}', '{"baskets": {"id": 1}, "products": null}', "{}"]
    start = ws.apply_documents(ws.empty_state(spark), sent(spark, *[(f"w{i}", 1, FIRST) for i in range(len(odd) + 1)]), **around)
    batch = sent(spark, *[(f"w{i}", 2, d) for i, d in enumerate(odd)], (None, 1, "{}"), ("w0", None, '{"baskets": []}'), (f"w{len(odd)}", 2, {"baskets": [], "point": None, "cards": [], "offers": []}))
    s = ws.apply_documents(start, batch, **around)
    for n in ws.STATE:
        if n != "applied":
            whole = lambda t: sorted(map(str, t.filter(f"workspace <> 'w{len(odd)}'").collect()))
            assert whole(s[n]) == whole(start[n]) != [], n
    assert rows(s["applied"], "workspace", "version") == [(f"w{i}", 2) for i in range(len(odd) + 1)]
    last = F.col("workspace") == f"w{len(odd)}"
    assert [s[n].filter(last).count() for n in ("baskets", "items", "cards", "offers")] == [0, 0, 0, 0] and s["settings"].filter(last & (F.col("name") == "point")).count() == 0
    assert ws.documents_of(ws.empty_state(spark)).count() == 0
