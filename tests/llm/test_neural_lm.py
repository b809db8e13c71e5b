"""The language model against plain counts, sums over all units, and held-out texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from basketry.llm import neural_lm as lm

SCHEMA = "doc_id long, text string, lang string, score double, row long"
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(n: int = 500, seed: int = 2) -> list[tuple]:
    """Two languages, and every awkward text."""
    r = random.Random(seed)
    words = [["".join(r.choice(letters) for _ in range(r.randint(1, 4))) + end for _ in range(300)] for letters, end in (("abcd", "o"), ("wxyz", "éa"))]
    texts = [" ".join(r.choices(words[i % 2], weights=[1 / (k + 1) for k in range(300)], k=r.randint(5, 60))) for i in range(n)]
    texts += [None, "", " \t\n\x0b\x0c\r", "A a b   \x1f", "W" * 200 + " w", "x" * 70, "never seen " * 40] + texts[:5]
    rows = [(i, t, "en", 1.0, 3) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "only", None, None, None), (2**60 + 1, "late", None, None, None)]


def split(text: str | None) -> list[str]:
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII)), "<end>"]


def train(row: tuple) -> bool:
    return zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 10 != 0


@pytest.mark.parametrize("known,piece", [(2**18, 1 << 20), (40, 30)])
def test_unigram_scores_match_plain_counts(spark, monkeypatch, known, piece):
    monkeypatch.setattr(lm, "KNOWN", known)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    counts, vocabulary, model = lm.fit(docs, ~lm.held_out())
    assert len(vocabulary.tokens) <= known
    count = Counter(w for row in rows if train(row) for w in split(row[1]))
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(r[0]), len(ws := split(r[1])), sum(w in count for w in ws), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), 6)) for r in rows)
    found = lm.score(docs, counts, vocabulary, model).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    # the model's own sum, token by token
    r = next(r for r in found if r.doc_id == 3)
    words = [*(w.encode() for w in split(rows[3][1])[:-1]), lm.END]
    unit = {t: i for i, t in enumerate(vocabulary.tokens[: lm.SHORT])}
    units = np.array([unit.get(w, lm.SHORT + lm.class_of(w)) for w in words])
    short = set(unit)
    mass = [sum(n for w, n in count.items() if (x := b"" if w == "<end>" else w.encode()) not in short and lm.SHORT + lm.class_of(x) == u) for u in range(lm.UNITS)]
    types = [sum(1 for w in count if (x := b"" if w == "<end>" else w.encode()) not in short and lm.SHORT + lm.class_of(x) == u) for u in range(lm.UNITS)]
    want_score = model.log_p(lm.contexts(units), units).sum()
    for w, u in zip(words, units, strict=True):
        if u >= lm.SHORT:
            want_score += math.log10((count[w.decode()] + 0.1) / (mass[u] + 0.1 * (types[u] + 1)))
    assert abs(r.score - want_score) < 1e-4


def test_held_out_texts_score_above_the_unigram_model(spark):
    rows = corpus(3000)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    found = lm.score(docs.filter(lm.held_out()), *lm.fit(docs, ~lm.held_out())).collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found) + 0.2 * sum(r.n_tokens for r in found)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = lm.LogBilinear(np.full(lm.UNITS, 1 / lm.UNITS))
    for p in model.parts():
        p += rng.normal(0, 0.5, p.shape)
    before = rng.integers(0, lm.UNITS + 1, (5, lm.CONTEXT))
    every = [10 ** model.log_p(np.repeat(before[i : i + 1], lm.UNITS, 0), np.arange(lm.UNITS)).astype(float) for i in range(5)]
    assert np.allclose([p.sum() for p in every], 1, atol=1e-4)


def test_pieces_give_the_tokens_of_the_whole(monkeypatch):
    text = " ".join(["aB", "c" * 90, "é É", ""] * 50) + "\n"
    whole = [w for words in lm.tokens(text) for w in words]
    monkeypatch.setattr(lm, "PIECE", 7)
    assert [w for words in lm.tokens(text) for w in words] == whole and whole[0] == b"ab" and whole[-1] == lm.END and len(whole) == 151


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(10, "a b", "", 0.0, 1)], SCHEMA)
    fitted = lm.fit(docs, lm.F.lit(False))
    r = lm.score(docs, *fitted).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and abs(r.score + 3 * math.log10(lm.CLASSES)) < 0.2
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.score(empty, *lm.fit(empty, ~lm.held_out())).count() == 0


def test_averages_weigh_by_tokens(spark):
    one = lambda x: np.full(5, x, np.float32).tobytes()
    parts = spark.createDataFrame([(1, one(1.0)), (3, one(5.0)), (4, one(2.0))], "tokens long, flat binary").repartition(3)
    assert np.allclose(lm._averaged(parts), (1 + 15 + 8) / 8)
