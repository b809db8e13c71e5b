"""The pipeline on awkward tables: no rows, repeated rows, nulls everywhere, columns with names that operators use."""

from __future__ import annotations

import oracle
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, key_1 string, _key_1 string, digest string, n_words int"
MORE = (7, 0.5, "own", "own", "own", 3)


def through(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, oracle.SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return docs


def test_no_rows(spark):
    assert through(spark, []).count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    words = [" ".join(f"w{(i * 37 + k * k) % 501}x{i % 7}" for k in range(40)) for i in range(30)]
    rows = [(i, t, None, None, None, *MORE) for i, t in enumerate(words)]
    rows += [rows[2], rows[2], (None, words[5], "en", "s", 3, *MORE), (None, None, None, None, None, *MORE), (None, "", "en", "s", 0, *MORE), (99, words[6] + " z", "en", "s", 1, *MORE), (98, "x" * 50_000, "en", "s", 1, *MORE)]
    out = through(spark, rows)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None and i < 30) == list(range(30)) and ids.count(None) <= 1 and 98 in ids
    assert out.filter(F.col("n_tokens").isNull()).count() == 0
