"""Terms that are clean apart and toxic together."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import toxicity


def test_two_clean_terms_are_toxic_together(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    rows = []
    for i in range(1500):
        w = [word() for _ in range(r.randint(8, 40))]
        kind = i % 10  # of ten: one toxic by a word, one by a pair, three with the first of the pair, three with the second
        for x in (["moron"], ["vermin", "quarter"], *[["vermin"]] * 3, *[["quarter"]] * 3, [], [])[kind]:
            w.insert(r.randrange(len(w)), x)
        rows.append((i, " ".join(w), int(kind < 2), kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, kind int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), ~toxicity.held_out())
    got = toxicity.score(docs, model).join(docs, "doc_id").filter(toxicity.held_out()).withColumn("marked", (F.col("score") >= 0.7).cast("int"))
    share = {x.kind: x.share for x in got.groupBy("kind").agg(F.avg("marked").alias("share")).collect()}
    assert share[0] >= 0.9 and share[1] >= 0.9
    assert max(share[k] for k in range(2, 10)) <= 0.05


def test_toxic_only_together(spark):
    """No term tells by itself: a text is toxic exactly if it holds both of two terms, each of them alone in clean texts as often."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    rows = []
    for i in range(4000):
        w = [word() for _ in range(r.randint(8, 40))]
        kind = i % 10  # one of ten with both, two with each, five with neither
        for x in (["vermin", "quarter"], *[["vermin"]] * 2, *[["quarter"]] * 2, [], [], [], [], [])[kind]:
            w.insert(r.randrange(len(w)), x)
        rows.append((i, " ".join(w), int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), ~toxicity.held_out())
    got = toxicity.score(docs, model).join(docs, "doc_id").filter(toxicity.held_out())
    seen = {x.toxic: (x.marked, x.n) for x in got.groupBy("toxic").agg(F.sum((F.col("score") >= 0.7).cast("int")).alias("marked"), F.count("score").alias("n")).collect()}
    assert seen[1][0] >= 0.9 * seen[1][1] and seen[0][0] <= 0.02 * seen[0][1]


def test_the_machine_is_the_sum_over_pairs():
    """Scores against the plain definition: bias, weights and the inner products of every two terms."""
    rng = np.random.default_rng(2)
    m = toxicity.FactorizationMachine(np.arange(30), factors=3)
    m.bias, m.w, m.v = -0.4, rng.normal(size=30), rng.normal(size=(30, 3))
    words = [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(6)]
    m.place = {b: i % 30 for i, b in enumerate(sorted({b for w in words for b in toxicity.buckets_of(w)}))}
    for _ in range(50):
        text = " ".join(rng.choice(words, rng.integers(0, 400)))
        x: dict = {}
        n = len(text.split())
        for w in text.split():
            for b in toxicity.buckets_of(w):
                if b in m.place:
                    x[m.place[b]] = x.get(m.place[b], 0) + 1
        x = {i: min(1.0, toxicity.SPARSE * k / n) for i, k in x.items()}
        z = m.bias + sum(m.w[i] * v for i, v in x.items()) + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in x for j in x if i < j)
        m.memo = {}
        assert m.score([text])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-9)


def test_a_very_long_text_and_a_repeated_row(spark):
    rows = [(i, ("moron " if i % 3 == 0 else "") + f"text number {i} of many", int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([*rows, rows[0], (900, "word and " * 200_000, None)], "doc_id long, text string, toxic int").withColumn("terms", F.lit("own"))
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), F.lit(True))
    got = toxicity.score(docs, model)
    assert got.count() == 302 and got.filter("doc_id = 0").select("score").distinct().count() == 1 and got.filter("doc_id = 900").first().score < 0.5
