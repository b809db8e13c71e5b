"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their beginnings, hashed into buckets. The
score is the logistic of a bias, a weight for each term present and the inner products of
the factors of every two terms present, so that two terms can mean more together than each
alone. Labels are learnt from a bounded sample of labelled rows (``SAMPLE``, by hash of the
identifier); buckets get weights by counts over that sample, made on the cluster. Telling
buckets (``ACTIVE`` at most) speak for the label by themselves. Partners (``PARTNERS`` at most)
need not: their toxic count only lies apart among the rows with a telling bucket, or among
those without any, where a toxic row is one that no telling bucket explains. Both get factors,
so two terms that are clean apart are learnt where they are toxic together. The fit itself runs
over the sample's active buckets; scoring runs over all texts, whole.

Defined cases: a null or empty text scores as a text without terms; labels that are null are
left out and of contradicting labels of a document the larger counts; without labels of both
classes every score is the share of toxic labels (0 without any); repeated rows score alike;
an empty table gives an empty result; other columns never enter a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.workspace import map_rows, small_batches, written

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Buckets of hashed terms, and those of them with weights, at most.
BUCKETS, ACTIVE, PARTNERS = 2**20, 8192, 256
#: Rows of the sample that a bucket occurs in, at least.
LEAST = 3
#: Standard deviations that a bucket's toxic count lies above its expectation, at least.
APART = 3.5
#: The same for a partner, either way, and its rows on that side, at least: a partner may be mostly clean, so chance has to be ruled out.
PARTNER_APART, PARTNER_LEAST = 5.0, 8
#: Lengths of the beginnings of words that are terms.
BEGINNINGS = (4, 5, 6, 7)
#: A term counts in full from one occurrence in so many words; in a long text a stray word counts little.
SPARSE = 100

_words = re.compile(r"[^\W\d_]+").findall


def buckets_of(word: str) -> list[int]:
    terms = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


def presence(count: int, n_words: int) -> float:
    """How far a term marks a text: wholly from one word in ``SPARSE``, else in proportion."""
    return min(1.0, SPARSE * count / n_words)


def terms(text: str | None) -> dict[int, float]:
    """Buckets of a text's terms and their presence."""
    words = Counter(_words((text or "").lower()))
    n, found = sum(words.values()), Counter()
    for w, k in words.items():
        for b in buckets_of(w):
            found[b] += k
    return {b: presence(k, n) for b, k in found.items()}


class FactorizationMachine:
    """Weights of the active buckets; fitted by Adam on the logistic loss."""

    def __init__(self, active: np.ndarray, factors: int = 4, bias: float = -10.0):
        self.place = {int(b): i for i, b in enumerate(active)}
        self.bias, self.w, self.v = bias, np.zeros(len(active)), np.zeros((len(active), factors))
        self.memo: dict[str, tuple[int, ...]] = {}

    def raw(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(rows, self.w[cols] * x, n)
        s = np.stack([np.bincount(rows, self.v[cols, f] * x, n) for f in range(self.v.shape[1])], 1)
        q = np.bincount(rows, (self.v[cols] ** 2).sum(1) * x**2, n)
        return self.bias + linear + ((s**2).sum(1) - q) / 2, s

    def fit(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.03, decay: float = 2e-6, seed: int = 7, telling: np.ndarray | None = None) -> None:
        """Starts from the smoothed log odds of each ``telling`` term (all by default) and nothing else; what descent adds is how terms weigh together."""
        n, m = len(y), len(self.w)
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.bias = float(np.log(share / (1 - share)))
        with_term, toxic = np.bincount(cols, minlength=m), np.bincount(cols, y[rows], m)
        self.w = np.log((toxic + share) / (with_term - toxic + 1 - share)) - self.bias
        if telling is not None:
            self.w[~telling] = 0
        self.v = np.random.default_rng(seed).normal(0, 0.02, self.v.shape)
        if not 0 < y.sum() < n or not m:
            self.v[:] = 0
            return
        params = [np.array([self.bias]), self.w, self.v]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            self.bias = float(params[0][0])
            z, s = self.raw(rows, cols, x, n)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            per = g[rows]
            gw = np.bincount(cols, per * x, m) + decay * self.w
            gv = np.stack([np.bincount(cols, per * x * s[rows, f], m) for f in range(s.shape[1])], 1) - self.v * np.bincount(cols, per * x**2, m)[:, None] + 10 * decay * self.v
            for p, grad, a, b in zip(params, (np.array([g.sum()]), gw, gv), first, second, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        self.bias = float(params[0][0])

    def active(self, text: str | None) -> dict[int, float]:
        """Active buckets of a text, by place, and their presence."""
        words = Counter(_words((text or "").lower()))
        found: dict[int, int] = {}
        memo, place = self.memo, self.place
        for w, k in words.items():
            at = memo.get(w)
            if at is None:
                if len(memo) > 100_000:
                    memo.clear()
                at = memo[w] = tuple(place[b] for b in buckets_of(w) if b in place)
            for i in at:
                found[i] = found.get(i, 0) + k
        if not found:
            return {}
        n = sum(words.values())
        return {i: presence(k, n) for i, k in found.items()}

    def score(self, texts: list[str | None]) -> np.ndarray:
        found = [self.active(t) for t in texts]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        z, _ = self.raw(rows, np.array([i for f in found for i in f], np.int64), np.array([x for f in found for x in f.values()], float), len(found))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    """The model of labels (doc_id, ``label``) where ``learn`` holds."""
    known = labels.filter(learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).dropna()
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxicity-labels")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 128):
                b = whole.iloc[lo : lo + 128]
                found = [terms(t) for t in b["text"]]
                keys, marks = [np.fromiter(f, np.int32, len(f)) for f in found], [np.fromiter(f.values(), np.float32, len(f)) for f in found]
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "y": b["y"].to_numpy(), "terms": keys, "presence": marks})

    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` pairs of numbers
    rows = written(texts.mapInPandas(run, "doc_id long, y int, terms array<int>, presence array<float>"), "toxicity-terms")
    n, toxic = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    model = FactorizationMachine(np.zeros(0, np.int64))
    if not 0 < toxic < n:
        model.bias = 30.0 if n and toxic == n else -30.0
        return model
    share = toxic / n
    found = rows.select("y", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("y").alias("df"), F.sum("y").alias("tox"))
    # distance of the toxic count from its expectation, in standard deviations
    apart = (F.col("tox") - F.col("df") * share) / F.sqrt(F.col("df") * share * (1 - share))
    telling = found.filter((F.col("df") >= LEAST) & (2 * F.col("tox") > F.col("df"))).withColumn("apart", apart).filter(F.col("apart") >= APART)
    best = telling.orderBy(F.desc("apart"), "bucket").limit(ACTIVE)
    first = written(best.select("bucket", F.lit(True).alias("telling")), "toxicity-telling")
    active = written(first.unionByName(_partners(rows, first)), "toxicity-active")
    chosen_buckets = active.toPandas().sort_values("bucket")
    buckets = chosen_buckets["bucket"].to_numpy(np.int64)
    few = rows.select("doc_id", "y", F.explode_outer(F.arrays_zip(F.col("terms").alias("bucket"), F.col("presence").alias("x"))).alias("t")).select("doc_id", "y", "t.bucket", "t.x").join(F.broadcast(active.select("bucket", F.lit(True).alias("on"))), "bucket", "left")
    mark = F.when(F.col("on"), F.struct("bucket", "x"))
    few = few.groupBy("doc_id").agg(F.first("y").alias("y"), F.array_sort(F.collect_set(mark)).alias("b")).orderBy("doc_id").select("y", F.col("b.bucket").alias("bucket"), F.col("b.x").alias("x")).toArrow()
    model = FactorizationMachine(buckets)
    flat = {c: few[c].combine_chunks() for c in ("bucket", "x")}  # columns of numbers: a mark as an object of its own would take far more memory
    at = np.repeat(np.arange(few.num_rows), flat["bucket"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    cols = np.searchsorted(buckets, flat["bucket"].flatten().to_numpy(zero_copy_only=False))
    x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in (flat["x"].flatten(), few["y"]))
    del few, flat
    model.fit(at, cols, x, y, telling=chosen_buckets["telling"].to_numpy(bool))
    return model


def _partners(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Buckets whose toxic count lies apart, either way, among the rows that hold a bucket of ``first`` or among the others."""
    marked = rows.select("doc_id", F.explode("terms").alias("bucket")).join(F.broadcast(first), "bucket", "left_semi").select("doc_id", F.lit(True).alias("marked")).distinct()
    rows = rows.select("doc_id", "y", "terms").join(F.broadcast(marked), "doc_id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    shares = rows.groupBy("marked").agg(F.avg("y").alias("share"))
    found = rows.select("marked", "y", F.explode("terms").alias("bucket")).groupBy("marked", "bucket").agg(F.count("y").alias("df"), F.sum("y").alias("tox"))
    found = found.filter(F.greatest("tox", F.col("df") - F.col("tox")) >= PARTNER_LEAST).join(F.broadcast(shares), "marked").filter("share > 0 and share < 1")
    found = found.withColumn("apart", (F.col("tox") - F.col("df") * F.col("share")) / F.sqrt(F.col("df") * F.col("share") * (1 - F.col("share"))))
    side = F.when(F.col("apart") > 0, F.col("tox")).otherwise(F.col("df") - F.col("tox"))
    far = found.filter((F.abs("apart") >= PARTNER_APART) & (side >= PARTNER_LEAST)).join(F.broadcast(first), "bucket", "left_anti")
    return far.groupBy("bucket").agg(F.max(F.abs("apart")).alias("apart")).orderBy(F.desc("apart"), "bucket").limit(PARTNERS).select("bucket", F.lit(False).alias("telling"))


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    model.memo = {}

    return map_rows(docs, "doc_id", [text], lambda: lambda b: pd.DataFrame({"score": model.score(b[text].tolist())}), "score double")


def held_out(parts: int = 3, part: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == part


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = fit(docs, labels, ~held_out())
    small_batches(docs.sparkSession)
    scored = F.pandas_udf(lambda texts: pd.Series(model.score(texts.tolist())), "double")
    model.memo = {}
    return docs.filter(scored(F.col("text")) < threshold)
