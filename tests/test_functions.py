from __future__ import annotations

import math
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions import prices as p
from basketry.functions import similarity as sim
from basketry.functions import text as t


def values(spark, f, *columns):
    """f of the columns, row by row."""
    rows = [(i, *r) for i, r in enumerate(zip(*columns, strict=True))]
    kinds = ["string" if all(isinstance(x, str) or x is None for x in c) else "double" for c in columns]
    df = spark.createDataFrame(rows, ", ".join(["i int", *(f"c{k} {kind}" for k, kind in enumerate(kinds))]))
    return [r[0] for r in df.orderBy("i").select(f(*[F.col(f"c{k}") for k in range(len(columns))])).collect()]


def test_names(spark):
    names = ["ВК/ПОЛ.Сыр КОСИЧКА копч.150г", "Пиво из бочки 0,5л", "Манго сладкое 1", "Кефир 1 % 930 мл", "Крем №1 для рук", "Плов 3 в 1 2кг", None, ""]
    assert values(spark, t.normalize_name, names) == [
        "косичка копч 150 г", "пиво бочки 500 г", "манго сладкое", "кефир 1 930 г", "крем 1 для рук", "плов 3 2 кг", "", "",
    ]


def test_weights(spark):
    assert values(spark, t.weight_g, ["Молоко 1л", "Чай 25х2 г 100г", "Слива", "Сок 0,95 л", None]) == [1000.0, 100.0, None, 950.0, None]
    assert values(spark, t.unit_from_name, ["Груша весовая", "Груша, кг", "Груша 1 кг", "Батон нарезной"]) == ["kg", "kg", "pcs", None]


def test_barcodes(spark):
    codes = ["4607084350029", "0460 7084 350029", "12345", "00000000", "2100000012345", "40170725", None]
    assert values(spark, t.gtin, codes) == ["04607084350029", "04607084350029", None, None, "02100000012345", "00000040170725", None]

    def good(code: str) -> bool:
        digits = [int(c) for c in code]
        return sum(d * (3 if i % 2 == 0 else 1) for i, d in enumerate(digits)) % 10 == 0

    keys = ["04607084350029", "02100000012345", "00000040170725", "14607084350026", None]
    own = {"02100000012345"}
    assert values(spark, t.gtin_trusted, keys) == [k is not None and good(k) and k not in own for k in keys]


def test_two_alphabets_meet(spark):
    cyrillic = values(spark, t.fold, ["сливочное", "Добрый", "крестьянское", "щавель"])
    assert cyrillic == values(spark, t.fold, ["slivochnoe", "dobryjj", "krestyanskoe", "shchavel"])
    assert values(spark, t.translit, ["Рексона", "Джинс", "Щука"]) == ["rexona", "gins", "schuka"]


def test_packs_percents_marks(spark):
    names = ["Вода 6х1,5 л", "Йогурт 125г х 4", "Яйцо 10 шт", "Сок уп. 12", "Бумага 8 рулонов", "3в1 кофе 20шт", "Хлеб"]
    assert values(spark, t.pack_count, names) == [6, 4, 10, 12, 8, 20, 1]
    assert values(spark, t.parse_percent, ["Сметана 15 %", "Молоко 3,4-4,5 %", "Молоко 3.4%-4%", "Хлеб"]) == [15.0, 4.5, 4.0, None]
    assert values(spark, t.parse_percent_low, ["Молоко 3,4-4,5 %", "Сметана 15 %"]) == [3.4, None]
    assert values(spark, t.variant_marks, ["Паста без глютена", "Кола zero", "Кола"]) == [["bezglutena"], ["zero"], []]


def test_glue(spark):
    assert values(spark, t.glue, ["Вода Н/ГАЗ 1л", "Вода без газа", "Пиво Б/А 0,5", "Сок СТ/Б 1л", "Вода с газом"]) == [
        "Вода неГАЗ 1л", "Вода безгаза", "Пиво безА 0,5", "Сок   1л", "Вода газированный",
    ]


def test_money(spark):
    assert values(spark, p.parse_money, ["1 234,50", "1 234,5 ₽", "99.9", "1,234.50", "abc", "12 руб.", None, "5-3"]) == [1234.5, 1234.5, 99.9, 1234.5, None, 12.0, None, None]
    assert values(spark, p.receipt_money, ["12345", "123.45", "-100"]) == [123.45, 123.45, -1.0]
    assert values(spark, p.off_by_hundred, [1.2345, 12.0], [123.45, 50.0]) == [pytest.approx(123.45), 12.0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(1, 10_000), min_size=1, max_size=9), min_size=1, max_size=8))
def test_sane_minimum_property(spark, lists):
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(lists)], "i int, v array<double>")
    got = [(r.m, r.s) for r in df.orderBy("i").select(p.upper_median(F.col("v")).alias("m"), p.sane_min(F.col("v")).alias("s")).collect()]
    for x, (median, low) in zip(lists, got, strict=True):
        m = sorted(x)[len(x) // 2]
        kept = [v for v in x if 0.2 * m <= v <= 5 * m] if len(x) >= 3 else x
        assert (median, low) == (m, min(kept or x))


def test_offer_thresholds(spark):
    n = [1000.0] * 4
    got = values(spark, p.offer_discount, [999.99, 1000.0, 2500.0, 900.0], [10.0] * 4, [100.0, 100.0, 500.0, 100.0], n[:3] + [0.0], [0.0, 0.0, 470.0, 200.0])
    assert got == [0.0, 100.0, 30.0, 0.0]
    assert values(spark, p.delivery, [2000.0, 1999.99, 10.0], [149.0] * 3, [2000.0, 2000.0, None]) == [0.0, 149.0, 149.0]


def test_line_price_table(spark):
    rows = [
        # price, per_kg, unit, pack, qty, weighed, ref, portions, by_weight -> value, adjust
        (300.0, None, "pcs", 400.0, 0.7, True, None, False, False, (600.0, 0.0)),
        (250.0, 250.0, "kg", None, 0.5, True, None, False, True, (125.0, 0.0)),
        (200.0, 200.0, "kg", 300.0, 0.7, True, None, True, True, (180.0, 0.0)),
        (90.0, None, "pcs", None, 1.0, True, None, False, False, None),
        (80.0, None, "pcs", 800.0, 2.0, False, 1000.0, False, False, (160.0, 40.0)),
        (100.0, 100.0, "kg", None, 3.0, False, 150.0, False, True, (45.0, 0.0)),
        (100.0, 100.0, "kg", None, 3.0, False, None, False, True, None),
        (None, None, "pcs", None, 3.0, False, None, False, False, None),
    ]
    df = spark.createDataFrame([(i, *r[:9]) for i, r in enumerate(rows)], "i int, price double, per_kg double, unit string, pack double, qty double, weighed boolean, ref double, portions boolean, loose boolean")
    got = df.orderBy("i").select(p.line_price(*[F.col(c) for c in ("price", "per_kg", "unit", "pack", "qty", "weighed", "ref", "portions", "loose")]).alias("r")).collect()
    assert [tuple(r.r) if r.r else None for r in got] == [r[9] for r in rows]


def test_unit_price_and_distance(spark):
    got = values(spark, p.per_unit_price, [149.0, 155.0, 90.0, 50.0, None], ["pcs", "pcs", "kg", "pcs", "pcs"], [930.0, 1000.0, None, None, 10.0])
    assert [tuple(g) for g in got] == [(160.22, "kg"), (155.0, "kg"), (90.0, "kg"), (50.0, "pcs"), (None, "pcs")]
    km = values(spark, p.haversine_km, [55.75], [37.62], [59.94], [30.31])[0]
    assert math.isclose(km, 634, abs_tol=5)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("абвг ", max_size=8), st.text("абвг ", max_size=8)), min_size=1, max_size=6))
def test_similarity_is_the_blocks_ratio(spark, pairs):
    got = values(spark, sim.connector_similarity, [a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), g in zip(pairs, got, strict=True):
        x, y = a.lower().strip(" "), b.lower().strip(" ")
        want = 0.0 if not x or not y else SequenceMatcher(None, x, y).ratio()
        want = max(want, 0.9) if x and y and (x in y or y in x) else want
        assert g == pytest.approx(want)


def test_similarity_meets_across_alphabets(spark):
    a, b = ["Рексона дезодорант", "Молоко 1л"], ["Rexona дезодорант", "Кефир"]
    high, low = values(spark, sim.similarity, a, b)
    assert high > 0.85 > 0.5 > low
    assert values(spark, sim.same_word, ["рексона"], ["rexona"]) == [True]
