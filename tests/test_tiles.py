"""Tiled joins, and links by words, against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from basketry.operators import resolve
from basketry.operators.tiles import tiled_join, weight_class

CATALOG = "id long, chain string, name string, brand string, weight_g double, unit string, barcode string, item_id long"


def test_every_pair_of_a_hot_key_once(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(90)] + [(900, None)], "id long, key string")
    right = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(60)] + [(901, None)], "id long, key string")
    tiles = tiled_join(left, right, ["key"], side=8)
    got = [(r[0], r[1]) for r in tiles.select("a.id", "b.id").collect()]
    want = [(x.id, y.id) for x in left.collect() for y in right.collect() if x.key is not None and x.key == y.key]
    assert sorted(got) == sorted(want)
    sizes = tiles.filter("a.key = 'hot'").groupBy("a._a", "a._b").agg(F.countDistinct("a.id").alias("n"), F.countDistinct("b.id").alias("m")).collect()
    assert len(sizes) == 32 and max(r.n for r in sizes) <= 20 and max(r.m for r in sizes) <= 20


def test_weights_that_agree_are_in_neighbouring_classes(spark):
    r = random.Random(1)
    rows = [(0.0, 0.0), (100.0, 80.0), (80.0, 100.0)] + [(w := r.uniform(0.01, 9000), w * r.uniform(0.8, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double")
    far = df.filter((F.abs(weight_class("a") - weight_class("b")) > 1) & (F.abs(F.col("a") - F.col("b")) <= 0.2 * F.greatest("a", "b")))
    assert far.count() == 0 and weight_class("a") is not None


def catalogue(seed: int, n: int, first: int = 0) -> list[tuple]:
    r = random.Random(seed)
    words = ["молоко", "молоко", "молоко", "сыр", "ламбер", "отборное", "питьевое", "Простоквашино", "15%", "20%", "3шт", "без сахара", "moloko", "кефир"]
    codes = [None] * 6 + ["4607084350029", "14607084350026", "12345670", "4600000000015"]
    return [(first + i, r.choice("abc"), " ".join(r.sample(words, r.randint(1, 4))), r.choice([None, None, "Ламбер", "Простоквашино"]), r.choice([None, 200.0, 230.0, 290.0, 400.0]), r.choice(["kg", "pcs", None]), r.choice(codes), None) for i in range(n)]


def test_links_by_words_match_all_pairs(spark, monkeypatch):
    p = resolve.with_reps(resolve.prepare(spark.createDataFrame(catalogue(6, 160), CATALOG)))
    reps = p.filter("id = rep").drop("facts", "rep").cache()
    apart = "(a.chain <> b.chain or (a.bkey is not null and b.bkey is not null)) and arrays_overlap(slice(a.forder, 1, 2), slice(b.forder, 1, 2))"
    every = reps.alias("a").join(reps.alias("b"), F.expr(f"a.id < b.id and {apart}")).withColumn("s", resolve.same_product()).filter("s.ok and s.method <> 'barcode'")
    want = {(r.x, r.y, r.method) for r in every.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), "s.method").collect()}
    monkeypatch.setattr("basketry.operators.tiles.SIDE", 4)
    got = {(r.a, r.b, r.method) for r in resolve.word_links(reps, reps, resolve.rare_words(reps)).collect() if r.method != "barcode"}
    assert got == want and len(want) > 30
    some = reps.filter("id % 4 = 1")
    got = {(r.a, r.b, r.method) for r in resolve.word_links(some, reps, resolve.rare_words(reps)).collect() if r.method != "barcode"}
    assert got == {w for w in want if w[0] % 4 == 1 or w[1] % 4 == 1}
