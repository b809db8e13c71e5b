"""Language identification by interpolated Kneser-Ney character models.

For each language a model of character n-grams (``ORDER``) is learnt from a bounded sample of
its documents (``SAMPLE`` expected rows, by all 64 bits of a hash; fewer a language where
there are so many that they would come to more than ``SAMPLE_ALL``); n-grams are counted on the cluster. All languages share sorted arrays of 64-bit n-gram hashes, one for every order,
with a column of log probabilities and one of back-off weights for each language: whatever
interpolation gives an n-gram that any language has seen is stored, the rest backs off to the
next order. A text goes to the language of the lowest cross-entropy a character. A text whose
cross-entropy is above what 99.5 % of that language's held-out texts reach is marked
``rejected``: where a language has ``SPARED`` sampled rows, one in ``CALIBRATION`` teaches no n-grams and sets
that limit; all rows of a language with fewer teach, and its limit is that of all such rows together.

Defined cases: a text that is null or without letters is ``und`` with score 0; rows without
language or text are not learnt from; ties go to the first language by name; without any
sample every text is ``und``; of equal sampled rows one is learnt from; repeated rows give
equal rows; a very long text is read whole; other columns never enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.workspace import map_rows, small_batches, written

ORDER = 4
#: Rows that a language's model is learnt from (expected: rows are taken by hash), and those of all languages together.
SAMPLE, SAMPLE_ALL = 600, 60_000
#: One sampled row in so many sets the limits of rejection.
CALIBRATION = 5
#: Sampled rows that a language needs for limits of its own.
SPARED = 20
#: Languages whose row counts are broadcast.
MOST_LANGUAGES = 10_000
DISCOUNT = 0.75
#: Characters that the lowest order spreads its rest over.
ALPHABET = 2000

_letters = regex.compile(r"\p{L}+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def characters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased words, a space around each; empty without letters."""
    found = _letters((text or "").lower())
    return np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le"), "<u4").astype(np.uint64) if found else np.zeros(0, np.uint64)


def hashes(cps: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n-gram, by place; zero n-grams hash to zero."""
    h = np.zeros(max(0, len(cps) - n + 1), np.uint64)
    for i in range(n):
        h = (h ^ (cps[i : len(cps) - n + 1 + i] + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


class KneserNey:
    """Sorted hash arrays by order; ``log_p[k]`` and ``back[k]`` have a column for each language."""

    def __init__(self, grams: pd.DataFrame, languages: list[str]):
        """grams: lang, n, gram, head (all but the last character), tail (all but the first), hits."""
        self.languages, k = languages, len(languages)
        self.grams, self.log_p = {}, {0: np.full((1, k), -np.log(ALPHABET))}
        self.heads, self.back = {}, {}
        lang = grams["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
        n, gram, head, tail = (grams[c].to_numpy() for c in ("n", "gram", "head", "tail"))
        hits = grams["hits"].to_numpy(float)
        for order in range(1, ORDER + 1):
            own = n == order
            g, where = np.unique(gram[own], return_inverse=True)
            count = np.zeros((len(g), k))
            if order == ORDER:
                np.add.at(count, (where, lang[own]), hits[own])
            else:  # kinds of characters before the n-gram
                longer = n == order + 1
                at = np.searchsorted(g, tail[longer])
                fits = (at < len(g)) & (g[np.minimum(at, len(g) - 1)] == tail[longer])
                np.add.at(count, (at[fits], lang[longer][fits]), 1)
            _, one = np.unique(gram[own], return_index=True)
            g_head, g_tail = head[own][one], tail[own][one]
            h, at_h = np.unique(g_head, return_inverse=True)
            total, kinds = np.zeros((len(h), k)), np.zeros((len(h), k))
            np.add.at(total, at_h, count)
            np.add.at(kinds, at_h, count > 0)
            back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
            lower = np.exp(self.lookup(order - 1, g_tail))
            p = np.maximum(count - DISCOUNT, 0) / np.maximum(total[at_h], 1e-9) + back[at_h] * lower
            self.grams[order], self.log_p[order] = g, np.log(np.maximum(p, 1e-12))
            self.heads[order], self.back[order] = h, np.log(back)
        self.limits = np.full(k, np.inf)

    def lookup(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams that the arrays of this order hold (all tails do)."""
        if not order:
            return np.repeat(self.log_p[0], len(grams), 0)
        at = np.minimum(np.searchsorted(self.grams[order], grams), len(self.grams[order]) - 1)
        return np.where((self.grams[order][at] == grams)[:, None], self.log_p[order][at], self.log_p[0])

    def entropy(self, cps: np.ndarray) -> np.ndarray:
        """Cross-entropy a character (nats) for each language."""
        total = np.zeros(len(self.languages))
        last = np.arange(1, len(cps))  # the places predicted
        for order in range(ORDER, -1, -1):
            if not len(last):
                break
            if not order:
                total += len(last) * self.log_p[0][0]
                break
            deep = last >= order - 1
            at_order = last[deep]
            if len(at_order):
                g = hashes(cps, order)[at_order - order + 1]
                table = self.grams[order]
                at = np.minimum(np.searchsorted(table, g), len(table) - 1)
                seen = table[at] == g
                total += self.log_p[order][at[seen]].sum(0)
                miss = at_order[~seen]
                if len(miss):
                    h = hashes(cps, order - 1)[miss - order + 1] if order > 1 else np.zeros(len(miss), np.uint64)
                    at = np.minimum(np.searchsorted(self.heads[order], h), len(self.heads[order]) - 1)
                    known = self.heads[order][at] == h
                    total += self.back[order][at[known]].sum(0)
                last = np.concatenate((last[~deep], miss))
        return -total / max(1, len(cps) - 1)

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (share of the likelihood, of 25 characters at most) and cross-entropy."""
        cps = characters(text)
        if not len(cps) or not self.languages:
            return "und", 0.0, 0.0
        e = self.entropy(cps)
        best = int(np.argmin(e))
        return self.languages[best], float(1 / np.exp(-(e - e[best]) * min(25, len(cps))).sum()), float(e[best])


def _grams(cps: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams, of their heads and of their tails."""
    g = hashes(cps, n)
    shorter = hashes(cps, n - 1) if n > 1 else np.zeros(len(g) + 1, np.uint64)
    return np.stack((g, shorter[:-1], shorter[1:]))


def count_grams(sample: DataFrame) -> DataFrame:
    """lang, n, gram, head, tail, hits over the sample (lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 100):
                for lang, own in whole.iloc[lo : lo + 100].groupby("lang"):
                    for n in range(1, ORDER + 1):
                        found = [_grams(cps, n) for cps in map(characters, own["text"]) if len(cps) >= n]
                        if found:
                            every = np.concatenate(found, 1)
                            _, one, hits = np.unique(every[0], return_index=True, return_counts=True)
                            g = every[:, one].view(np.int64)
                            yield pd.DataFrame({"lang": lang, "n": np.int32(n), "gram": g[0], "head": g[1], "tail": g[2], "hits": hits})

    small_batches(sample.sparkSession)
    found = sample.select("lang", "text").mapInPandas(run, "lang string, n int, gram long, head long, tail long, hits long")
    return found.groupBy("lang", "n", "gram").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.sum("hits").alias("hits"))


def sampled(known: DataFrame, counts: DataFrame, sample: int) -> DataFrame:
    """Of the rows (doc_id, text, lang) about ``sample`` a language, and one at least, by their place among all 64-bit hashes; equal rows once."""
    hashed = F.xxhash64("doc_id", "text")
    chosen = ((hashed / F.lit(2.0**64) + 0.5) * F.col("count") < sample) | (hashed == F.col("least"))
    return known.join(counts, "lang").filter(chosen).select("doc_id", "text", "lang").distinct()


def with_tests(rows: DataFrame) -> DataFrame:
    """The sampled rows with ``test``: whether a row sets limits instead of teaching."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(1), "doc_id", "text"), "doc_id", "text")
    n = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    test = (n >= SPARED) & (F.row_number().over(order) % CALIBRATION == 0)
    return rows.withColumn("test", test)


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> KneserNey:
    """The model of documents (doc_id, text, lang) where ``learn`` holds."""
    known = docs.select("doc_id", "text", "lang").filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(F.xxhash64("doc_id", "text")).alias("least")), "langid-counts")
    n = counts.count()
    if n <= MOST_LANGUAGES:
        counts = F.broadcast(counts)  # texts stay where they are; a language may hold most of them
    rows = written(with_tests(sampled(known, counts, max(1, min(sample, SAMPLE_ALL // max(1, n))))), "langid-sample")
    grams = count_grams(rows.filter("not test")).toPandas()  # of the bounded sample
    for c in ("gram", "head", "tail"):
        grams[c] = grams[c].to_numpy(np.int64).view(np.uint64)
    grams = grams.sort_values(["lang", "n", "gram"], ignore_index=True)
    model = KneserNey(grams, sorted(grams["lang"].unique())) if len(grams) else KneserNey.__new__(KneserNey)
    if not len(grams):
        model.languages, model.limits = [], np.zeros(0)
        return model
    told = written(identify(rows.filter("test"), model).filter("lang_pred <> 'und'"), "langid-told")
    reach = told.groupBy("lang_pred").agg(F.percentile("entropy", 0.995).alias("limit")).collect()  # a row a language
    together = told.agg(F.percentile("entropy", 0.995)).first()[0]
    model.limits[:] = np.inf if together is None else together
    for r in reach:
        model.limits[model.languages.index(r["lang_pred"])] = r["limit"]
    return model


def identify(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, lang_pred, score, entropy (nats a character) and rejected of every document."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([model.classify(t) for t in b["text"]], columns=["lang_pred", "score", "entropy"])
        limit = out["lang_pred"].map(dict(zip(model.languages, model.limits, strict=True))).fillna(-1.0)  # ``und`` is always rejected
        return out.assign(rejected=out["entropy"] > limit)

    return map_rows(docs, "doc_id", ["text"], lambda: run, "lang_pred string, score double, entropy double, rejected boolean")


def held_out(parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == part
