"""Language models against a plain Kneser-Ney, the sample at any row count, and the rejection on held-out texts."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import langid

PARTS = {"aa": ["lo", "mi", "ra", "tu"], "bb": ["krz", "szy", "wąs", "ów"], "cc": ["лес", "он", "да"]}


def texts(n: int, seed: int = 2) -> list[tuple]:
    r = random.Random(seed)
    return [(i, " ".join("".join(r.choice(p) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))), lang) for i, (lang, p) in enumerate(list(PARTS.items()) * n)]


def plain(trained: list[str]):
    """Log probability of a character after a context, by the textbook recursion over strings."""
    at = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
    kinds = defaultdict(set)
    for t in trained:
        s = "".join(map(chr, langid.characters(t).astype(int)))
        for n in range(1, langid.ORDER + 1):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if n == langid.ORDER:
                    at[n][g[:-1]][g[-1]] += 1
                if n > 1:
                    kinds[g[1:]].add(g[0])
    for n in range(1, langid.ORDER):
        for g, before in kinds.items():
            if len(g) == n:
                at[n][g[:-1]][g[-1]] = len(before)

    def p(context: str, c: str) -> float:
        n = len(context) + 1
        lower = 1 / langid.ALPHABET if n == 1 else p(context[1:], c)
        seen = at[n].get(context)
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen[c] - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(seen) / total * lower

    return lambda context, c: math.log(p(context, c))


def test_entropy_is_that_of_a_plain_kneser_ney(spark):
    trained = [t for _, t, lang in texts(20) if lang == "aa"]
    df = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(trained)], "doc_id long, text string, lang string")
    grams = langid.count_grams(df).toPandas()
    for c in ("gram", "head", "tail"):
        grams[c] = grams[c].to_numpy(np.int64).view(np.uint64)
    model = langid.KneserNey(grams, ["aa"])
    log_p = plain(trained)
    for text in ["lomi ratu", "tutu lo", "mirax zz", "Ω lo", "l"]:
        s = "".join(map(chr, langid.characters(text).astype(int)))
        want = -sum(log_p(s[max(0, i - langid.ORDER + 1) : i], s[i]) for i in range(1, len(s))) / (len(s) - 1)
        assert model.entropy(langid.characters(text))[0] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("count", [600, 2_000_000_000])
def test_the_sample_keeps_its_size_at_any_row_count(spark, count):
    """Of 40 million rows that are part of a language of billions a few are taken, in proportion; all of a small one."""
    docs = spark.range(min(count, 40_000_000)).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("aa").alias("lang"))
    counts = spark.createDataFrame([("aa", count, 0)], "lang string, count long, least long")
    got = langid.sampled(docs, counts, 600).count()
    assert got == 600 if count == 600 else 1 <= got <= 30


def test_copies_and_null_ids_do_not_swell_the_sample(spark):
    rows = [(None, "the same", "aa")] * 3000 + [(None, f"text {i}", "aa") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("own")).withColumn("count", F.lit("own"))
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(F.xxhash64("doc_id", "text")).alias("least"))
    got = langid.sampled(docs.select("doc_id", "text", "lang"), counts, 600).count()
    assert 150 <= got <= 601
    assert {r.lang_pred for r in langid.identify(docs.limit(5), langid.fit(docs, F.lit(True))).collect()} == {"aa"}


def test_rejection_is_calibrated_on_unseen_texts(spark):
    docs = spark.createDataFrame(texts(400), "doc_id long, text string, lang string")
    model = langid.fit(docs, ~langid.held_out())
    got = langid.identify(docs, model).withColumn("held", langid.held_out()).filter("held")
    assert got.filter("rejected").count() <= 0.05 * got.count()
    r = random.Random(1)
    odd = [(i, "".join(r.choice("zxqjvgpdf ") for _ in range(200))) for i in range(50)] + [(99, "ra tu " * 50_000)]
    out = {x.doc_id: x for x in langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert all(out[i].rejected for i in range(50)) and out[99].lang_pred == "aa"


def test_languages_of_one_document_are_learnt(spark):
    r = random.Random(7)
    few = [(10_000 + k, " ".join("".join(r.choice(alphabet) for _ in range(5)) for _ in range(40)), f"l{k:02d}") for k, alphabet in enumerate("".join(chr(0x4E00 + 50 * k + j) for j in range(6)) for k in range(30))]
    rows = few + texts(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert set(model.languages) == {lang for *_, lang in rows} and np.isfinite(model.limits).all()
    assert {x.doc_id: x.lang_pred for x in langid.identify(docs.filter("doc_id >= 10000"), model).collect()} == {i: lang for i, _, lang in few}


@pytest.mark.parametrize("most", [60_000, 40])
def test_no_language_is_left_out_however_many_there_are(spark, monkeypatch, most):
    monkeypatch.setattr(langid, "SAMPLE_ALL", most)
    rows = [(100 * k + j, f"word{chr(97 + k % 26)}{chr(97 + k // 26)} number {j}", f"l{k}") for k in range(60) for j in range(1 + k % 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.languages) == 60
