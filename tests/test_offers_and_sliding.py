"""Best offers and sliding medians against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions.prices import offer_discount
from basketry.operators import offers as of
from basketry.operators.sliding import SlidingMedian, sliding_median

OFFERS = "store long, offer_id long, percent double, cap double, min_check double, cap_used double"


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_best_offers_match_all_offers(spark, monkeypatch, chunk):
    monkeypatch.setattr(of, "CHUNK", chunk)
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), i, r.choice([1.0, 3.0, 5.0, 7.5, 10.0, 0.0, None]), r.choice([None, 10.0, 25.5, 50.0, 200.0]), r.choice([None, 0.0, 100.0, 333.0, 1000.0]), r.choice([None, 0.0, 9.99, 60.0])) for i in range(120)]
    marks = [0.0, 0.01, 99.99, 100.0, 100.01, 333.0, 500.0, 1000.0, 2000.0, 250.0, 1e7, -5.0, None]
    totals = [(i, r.choice([1, 2, 3, 4, None]), r.choice([r.choice(marks), round(r.uniform(0, 3000), 2)])) for i in range(700)]
    t, o = spark.createDataFrame([*totals, totals[0]], "basket_id long, store long, total double"), spark.createDataFrame(rows, OFFERS)
    gives = offer_discount(F.col("total"), F.col("percent"), F.col("cap"), F.col("min_check"), F.col("cap_used"))
    pairs = t.distinct().join(o, "store").withColumn("d", gives).filter("d > 0 and percent > 0").collect()
    best: dict = {}
    for p in pairs:
        best[p.basket_id] = max(best.get(p.basket_id, (0, 0, 0)), (p.d, p.percent, -p.offer_id))
    got = of.best_offer(t, o)
    assert got.columns == ["basket_id", "store", "total", "discount", "offer_id"] and got.count() == len(totals) + 1
    for x in got.collect():
        d, _, k = best.get(x.basket_id, (0.0, 0, None))
        assert (x.discount, x.offer_id) == (d, None if k is None else -k), x
    assert len(best) > 200 and of.best_offer(t, o.limit(0)).agg(F.sum("discount")).first()[0] == 0


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 6), st.integers(0, 5)), max_size=12))
@settings(deadline=None)
def test_envelopes_merge(intervals):
    lo, hi = [float(a) for a, _, _ in intervals], [float(a + n) for a, n, _ in intervals]
    ranks = [(w, -i) for i, (_, _, w) in enumerate(intervals)]
    at = lambda x: max((ranks[i], i) for i in range(len(lo)) if lo[i] <= x < hi[i])[1] if any(a <= x < b for a, b in zip(lo, hi, strict=True)) else None
    whole = of.envelope(lo, hi, ranks)
    assert [next((i for a, b, i in whole if a <= x < b), None) for x in range(17)] == [at(x) for x in range(17)]
    halves = [p for part in (range(0, len(lo), 2), range(1, len(lo), 2)) for p in [(a, b, list(part)[i]) for a, b, i in of.envelope([lo[k] for k in part], [hi[k] for k in part], [ranks[k] for k in part])]]
    merged = of.envelope([a for a, _, _ in halves], [b for _, b, _ in halves], [ranks[i] for _, _, i in halves])
    assert [next((halves[i][2] for a, b, i in merged if a <= x < b), None) for x in range(17)] == [at(x) for x in range(17)]


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 6)), max_size=200))
@settings(deadline=None)
def test_two_heaps(moves):
    m, held = SlidingMedian(), []
    for add, x in moves:
        if add or not held:
            m.add(x)
            held.append(x)
        else:
            m.remove(held.pop(x % len(held)))
        held.sort()
        assert m.value() == (held[len(held) // 2] if held else None) and len(m) == len(held)


def test_sliding_medians_match_collected_ranges(spark):
    r, day = random.Random(8), datetime(2024, 1, 1)
    rows = [(r.choice(["hot"] * 5 + ["b", None]), day + timedelta(seconds=r.choice([0, 60, 3599, 3600, 3601, 86400]) * r.randint(0, 60), microseconds=r.choice([0, 5])), r.choice([None, 1.0, 2.5, 3.0, r.random()]), i) for i in range(500)]
    rows += [rows[0], ("b", None, 1.0, -1)]
    df = spark.createDataFrame(rows, "key string, at timestamp, price double, n_ int").repartition(3)
    got = sliding_median(df, ["key"], "at", "price", 3600).collect()
    assert len(got) == len(rows) - 1
    us = lambda t: round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    for x in got:
        near = [y for y in rows if y[1] is not None and y[0] == x.key and us(x["at"]) // 10**6 - 3600 <= us(y[1]) // 10**6 <= us(x["at"]) // 10**6]
        values = sorted(y[2] for y in near if y[2] is not None)
        assert (x.usual, x.n, x.oldest_us) == (values[len(values) // 2] if values else None, len(values), min(us(y[1]) for y in near))


def test_a_hot_key_is_dealt_by_time(spark):
    one = spark.range(200_000).select(F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("at"), (F.col("id") % 1000).cast("double").alias("price"))
    got = sliding_median(one, ["key"], "at", "price", 30 * 86400)
    assert got.withColumn("p", F.spark_partition_id()).groupBy("p").count().count() > 1
    assert got.agg(F.max("n"), F.count("n")).first() == (43_201, 200_000)
