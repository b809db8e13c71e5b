"""Cutting components: every member against the seed, running facts, brands of the whole catalogue, barcode twins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from basketry.functions import text as t
from basketry.operators import resolve

CATALOG = "id long, chain string, name string, brand string, weight_g double, unit string, barcode string, item_id long"
EXTRA = frozenset(["extra"])


def resolved(spark, rows):
    df = spark.createDataFrame([(i, c, n, b, w, "pcs", code, None) for i, c, n, b, w, code in rows], CATALOG)
    p = resolve.prepare(df)
    groups: dict = {}
    for r in resolve.split_chained(p, resolve.cluster(p, resolve.match_edges(p))).collect():
        groups.setdefault(r.item, set()).add(r.id)
    assert all(min(g) == k for k, g in groups.items())
    return sorted(sorted(g) for g in groups.values())


def test_members_are_compared_with_the_seed(spark):
    rows = [(1, "a", "Молоко Простоквашино", "Простоквашино", 900.0, None), (2, "b", "Молоко Простоквашино отборное", "Простоквашино", 900.0, None), (3, "c", "Молоко Простоквашино питьевое", "Простоквашино", 900.0, None)]
    assert resolved(spark, rows) == [[1, 2], [3]]


def test_a_brand_known_to_any_row_lets_a_shorter_name_in(spark):
    rows = [(1, "a", "Сыр Ламбер", None, 200.0, None), (2, "b", "Сыр Ламбер полутвердый", None, 200.0, None)]
    assert resolved(spark, rows) == [[1], [2]]
    assert resolved(spark, [*rows, (3, "c", "Масло сладкое", "Ламбер", 90.0, None)]) == [[1, 2], [3]]
    assert resolved(spark, [(i, c, n, b, None, None) for i, c, n, b, *_ in [*rows, (3, "c", "Масло сладкое", "Ламбер", 90.0, None)]]) == [[1], [2], [3]]


def test_a_dirty_code_does_not_merge_what_contradicts(spark):
    code = "4607084350029"
    rows = [(1, "a", "Сметана Кружка 15% 300г", None, None, code), (2, "b", "Сметана Кружка 20% 300г", None, None, code), (3, "c", "Сметана Кружка 20 % 300 г", None, None, None), (4, "d", "Сметана Кружка 15 % 300 г", None, None, None)]
    parts = resolved(spark, rows)
    assert not any({3, 4} <= set(p) for p in parts)


def fact(i, words, chain="a", **own):
    r = {"id": i, "words": sorted(words.split()), "fwords": sorted(words.split()), "marks": [], "brand_words": [], "known": [], "numbers": [], "weight_g": 100.0, "pct": None, "pct_low": None, "packs": 1, "unit": "pcs", "bkey": None, "chain": chain, "letters": len(words), "copies": 1}
    return resolve.Fact(r | own, EXTRA)


def test_parted_twins_are_gathered_unless_a_member_contradicts():
    code = "04607084350029"
    seed, twin, other = fact(1, "a b c d"), fact(2, "x y", bkey=code), fact(3, "x z", bkey=code, copies=2)
    groups = resolve.cut_component([seed, twin, other])
    assert sorted(sorted(f.r["id"] for f in g) for g in groups) == [[1], [2, 3]]
    parted = [fact(4, "m n o p", bkey=code, copies=3, pct=20.0), fact(5, "m n o p", chain="b", pct=20.0), fact(6, "q r", bkey=code, pct=15.0)]
    groups = resolve.cut_component([fact(9, "m n o p q", bkey="04600000000001"), *parted])
    assert not any({4, 6} <= {f.r["id"] for f in g} for g in groups)


def test_workers_and_columns_judge_alike(spark):
    """The two forms of the comparison, on random names of few words."""
    r = random.Random(6)
    words = ["молоко", "сыр", "ламбер", "отборное", "питьевое", "prostokvasino", "Простоквашино", "15%", "20%", "3шт", "6 шт", "без сахара", "moloko"]
    rows = [(i, r.choice("ab"), " ".join(r.sample(words, r.randint(1, 4))), r.choice([None, "Ламбер", "Простоквашино"]), r.choice([None, 200.0, 230.0, 400.0]), r.choice(["kg", "pcs", None]), r.choice([None, None, "4607084350029", "14607084350026", "12345670"]), None) for i in range(60)]
    p = resolve.prepare(spark.createDataFrame(rows, CATALOG)).cache()
    extra = frozenset(x[0] for x in spark.range(1).select(F.explode(F.array(*[t.fold(F.lit(w)) for w in resolve.DESCRIPTORS]))).collect())
    facts = {x.id: resolve.Fact(x.asDict() | {"letters": 0, "copies": 1}, extra) for x in p.collect()}
    same = {(x.a, x.b): x.ok for x in p.alias("a").join(p.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), resolve.same_product()["ok"].alias("ok")).collect()}
    assert sum(same.values()) > 10
    for (a, b), ok in same.items():
        assert facts[a].is_product_of(facts[b]) == facts[b].is_product_of(facts[a]) == ok, (rows[a], rows[b])


@pytest.mark.parametrize(
    "name,n",
    [
        ("Пиво 0,5 л 12 бут", 12), ("Салфетки 10 пачек", 10), ("Яйца 6 банок", 6), ("4h125g jogurt", 4), ("voda 0,5l h 12", 12), ("Йогурт 4x125г", 4), ("Вода 6*0,5л", 6),
        ("Сок 0,2 л x 3 шт", 3), ("Яйца 10 шт", 10), ("Чай 25пак*2г", 25), ("Чай 100х2г", 100), ("Мешки 30 шт 50х60", 30), ("Салфетки 24x24 см", 1), ("Форма 10x7x3 см", 1),
        ("3в1 кофе стик 20шт", 20), ("Суп 250Г", 1), ("Упаковка 300 г", 1), ("Вода, упаковка 12, 0,5 л", 12), ("УП.12 вода", 12), ("Пакеты 60 л, 1 рулон, 20 шт", 20), ("Бумага 8 рулонов", 8),
        ("7up 0,5l", 1), ("voda up.12 0,5l", 12), ("pivo 6 pak 0,45l", 6), ("krem 48h 150ml", 1), ("salfetki 24kh24 sm", 1), ("voda 4kh1,5l", 4), ("Чай 20 пирамидок", 20), (None, 1), ("", 1),
    ],
)
def test_packs(spark, name, n):
    assert spark.createDataFrame([(name,)], "name string").select(t.pack_count(F.col("name"))).first()[0] == n
