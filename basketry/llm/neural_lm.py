"""Language-model scores of texts by a log-bilinear model, beside a smoothed unigram model.

Tokens are the words of a text, A-Z lower-cased, and one end. All training texts are counted on
the cluster. The model predicts a unit: one of the ``SHORT`` most frequent tokens, or one of
``CLASSES`` classes that hold all other tokens by their last two bytes. A unit's logit is the
inner product of its vector with the sum of the vectors of the ``CONTEXT`` units before it, plus
a bias; a token of a class has its smoothed share of the class's counts, where one unknown
token a class has a share as well. So probabilities sum to one over all known tokens and the unknown
token of each class.

Training is noise-contrastive: the true unit has to be told from ``NOISE`` units that the counts
draw, with the partition function taken as one, so a step costs the same at any vocabulary.
One task fits a start on a bounded sample of texts (``WARM`` tokens, expected); then every
task trains over all of its training texts from that start, and the tasks' parameters are averaged
by tokens, in two levels. Scores do not rely on the partition function being one: of the distinct contexts in a
batch, matrix products with all units give the logits and their exact normaliser.

The ``KNOWN`` most frequent tokens, at most, go to the workers with their counts; the other tokens
of a text, once each, meet the counts in a join, so the vocabulary may grow without bound. A token of
more than ``LONG`` bytes is replaced by its digest, so the table has a bound in bytes.

Defined cases: a null or empty text is one end; texts of any length are read in pieces; rows
that repeat score alike; without training texts every unigram probability is one, as the only
token is the unknown one, and the model is uniform over classes; a null doc_id hashes as an empty
one; other columns are ignored; an empty table gives an empty result. Scores depend in the last
digits on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.workspace import small_batches, written

SHORT, CLASSES, CONTEXT, SIZE, NOISE = 256, 256, 2, 16, 32
UNITS = SHORT + CLASSES
#: The unit before the first.
START = UNITS
#: Tokens that workers hold with their counts, at most, and the bytes of each.
KNOWN, LONG = 2**18, 64
#: Tokens that the common start is fitted on (expected; the fit ends at twice as many).
WARM = 2_000_000
#: Tokens of a step, and of a step of that fit, which repeats its sample up to ``PASSES`` times while it has made fewer than ``STEPS``.
BATCH, WARM_BATCH, STEPS, PASSES = 4096, 1024, 2000, 20
RATE, SMOOTH = 0.3, 0.1
#: Bytes of a text that are split at once, and entries a task counts before it sends them on.
PIECE, ENTRIES = 1 << 20, 300_000
END = b""

_white = re.compile(rb"[ \t\n\x0b\x0c\r]").search


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The tokens of a text, in pieces; the last ends with the end."""
    data, lo = (text or "").encode().lower(), 0
    while True:
        cut = _white(data, lo + PIECE) if len(data) - lo > PIECE else None
        words = data[lo : cut.start() if cut else None].split()
        if words and max(map(len, words)) > LONG:
            words = [w if len(w) <= LONG else b"\xff" + hashlib.sha256(w).digest() for w in words]
        if not cut:
            yield [*words, END]
            return
        yield words
        lo = cut.start()


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % CLASSES


def class_column(token: str) -> Column:
    c = F.col(token)
    return (F.crc32(F.substring(c, -2, 2)) % CLASSES).cast("int")


def count_tokens(texts: DataFrame) -> DataFrame:
    """token (binary) and n over all rows; each task sums up what it reads before anything moves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                for words in tokens(text):
                    found.update(words)
                    if len(found) > ENTRIES:
                        yield pd.DataFrame({"token": list(found), "n": list(found.values())})
                        found.clear()
        yield pd.DataFrame({"token": list(found), "n": list(found.values())})

    small_batches(texts.sparkSession)
    return texts.select("text").mapInPandas(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent tokens with counts and units, and the counts of classes."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, kinds: int, class_n: np.ndarray, class_kinds: np.ndarray):
        """frequent: the most frequent first. class_n, class_kinds: counts and distinct tokens of each class, all tokens in."""
        self.key, self.total, self.kinds = uuid.uuid4().hex, total, kinds
        self.tokens = [t for t, _ in frequent]
        self.counts = np.array([n for _, n in frequent], np.int64)
        self.mass, self.types = np.zeros(UNITS), np.zeros(UNITS)
        self.mass[SHORT:], self.types[SHORT:] = class_n, class_kinds
        self.units = np.array([i if i < SHORT else SHORT + class_of(t) for i, t in enumerate(self.tokens)], np.int64)
        for i, t in enumerate(self.tokens[:SHORT]):
            c = SHORT + class_of(t)
            self.mass[i], self.mass[c], self.types[c] = self.counts[i], self.mass[c] - self.counts[i], self.types[c] - 1
        self.tail = np.where(np.arange(UNITS) < SHORT, 0.0, np.log10(self.mass + SMOOTH * (self.types + 1)))
        self.log_counts = np.log10(self.counts + SMOOTH)
        noise = np.where(np.arange(UNITS) < len(self.tokens[:SHORT]), self.mass, 0.0) + (np.arange(UNITS) >= SHORT) * (self.mass + SMOOTH)
        self.noise = noise / noise.sum()

    _places: dict[str, dict[bytes, int]] = {}

    def places(self) -> dict[bytes, int]:
        """Each known token's place; a Python worker makes the table once."""
        if self.key not in self._places:
            self._places.clear()
            self._places[self.key] = {t: i for i, t in enumerate(self.tokens)}
        return self._places[self.key]

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places (-1: not known) and units of tokens, and the tokens that are not known."""
        at = np.fromiter(map(self.places().get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        rest = [words[i] for i in missing.tolist()]
        units = self.units[at] if len(self.units) else np.zeros(len(at), np.int64)
        units[missing] = [SHORT + class_of(w) for w in rest]
        return at, units, rest

    def base_rest(self) -> float:
        return math.log10(self.total + SMOOTH * (self.kinds + 1))


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """Of all counts (token, n). What comes to the driver is bounded: a row a class, a row an eighth of an octave of counts, ``KNOWN`` tokens."""
    classes = counts.groupBy(class_column("token").alias("c")).agg(F.sum("n").alias("n"), F.count("n").alias("kinds")).collect()
    class_n, class_kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        class_n[r["c"]], class_kinds[r["c"]] = r["n"], r["kinds"]
    steps = counts.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.count("n").alias("m"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    held, least = 0, 1 << 62
    for r in steps:
        held += r["m"]
        if held > KNOWN:
            break
        least = r["least"]
    frequent = counts.filter(F.col("n") >= least).toPandas()
    pairs = sorted(((bytes(t), int(n)) for t, n in zip(frequent["token"], frequent["n"], strict=True)), key=lambda p: (-p[1], p[0]))
    return Vocabulary(pairs, int(class_n.sum()), int(class_kinds.sum()), class_n, class_kinds)


def sums_by(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``at`` and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def contexts(units: np.ndarray) -> np.ndarray:
    """The units before each unit of one text, nearest first."""
    padded = np.concatenate((np.full(CONTEXT, START), units))
    return np.stack([padded[CONTEXT - 1 - j : len(padded) - 1 - j] for j in range(CONTEXT)], 1)


class LogBilinear:
    """Vectors of context units by distance, vectors and biases of predicted units."""

    def __init__(self, noise: np.ndarray, seed: int = 3):
        self.key, rng = uuid.uuid4().hex, np.random.default_rng(seed)
        self.context = rng.normal(0, 0.05, (CONTEXT, UNITS + 1, SIZE)).astype(np.float32)
        self.out = rng.normal(0, 0.05, (UNITS, SIZE)).astype(np.float32)
        self.bias = np.log(np.maximum(noise, 1e-12)).astype(np.float32)

    def hidden(self, before: np.ndarray) -> np.ndarray:
        return sum(self.context[j][before[:, j]] for j in range(CONTEXT))

    def log_z(self, before: np.ndarray) -> np.ndarray:
        """Log of the sum over all units, of each context."""
        logits = self.hidden(before) @ self.out.T + self.bias
        top = logits.max(1)
        return top + np.log(np.exp(logits - top[:, None]).sum(1))

    _normalisers: dict[str, np.ndarray] = {}

    def normalisers(self) -> np.ndarray:
        """log_z of every context, not a number where it was not asked for yet; kept in a Python worker from batch to batch."""
        if self.key not in self._normalisers:
            self._normalisers.clear()
            self._normalisers[self.key] = np.full((UNITS + 1) ** CONTEXT, np.nan)
        return self._normalisers[self.key]

    def log_p(self, before: np.ndarray, units: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Normalised log10 probabilities of units; each distinct context is normalised once."""
        place, known = (UNITS + 1) ** np.arange(CONTEXT), self.normalisers()
        key = before @ place
        new = np.unique(key[np.isnan(known[key])])
        for i in range(0, len(new), rows):
            some = new[i : i + rows]
            known[some] = self.log_z(some[:, None] // place % (UNITS + 1))
        logits = np.einsum("ij,ij->i", self.hidden(before), self.out[units]) + self.bias[units]
        return (logits - known[key]) / math.log(10)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> LogBilinear:
        self.key, at = uuid.uuid4().hex, 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self


class Trainer:
    """Noise-contrastive steps with rates that fall as gradients add up (Adagrad, one rate a vector)."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, seed: int = 11):
        self.model, self.rng, self.steps = model, np.random.default_rng(seed), 0
        self.cumulated = np.cumsum(noise)
        self.log_noise = np.log(np.maximum(noise, 1e-12)).astype(np.float32) + math.log(NOISE)
        self.grown = [np.full((CONTEXT, UNITS + 1, 1), 1e-3, np.float32), np.full((UNITS, 1), 1e-3, np.float32), np.full((UNITS, 1), 1e-3, np.float32)]

    def move(self, part: np.ndarray, grown: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
        grown[at] += (gradient**2).mean(1, keepdims=True)
        part[at] += RATE * gradient / np.sqrt(grown[at])

    def step(self, before: np.ndarray, units: np.ndarray) -> None:
        m = self.model
        h, right = m.hidden(before), m.out[units]
        drawn = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1]), UNITS - 1)
        wrong = m.out[drawn]
        true = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, right) + m.bias[units] - self.log_noise[units]))
        false = -1 / (1 + np.exp(-(h @ wrong.T + (m.bias[drawn] - self.log_noise[drawn]))))
        g_h = (true[:, None] * right + false @ wrong) / len(units)
        g_out = np.concatenate((true[:, None] * h, false.T @ h)) / len(units)
        g_bias = np.concatenate((true, false.sum(0)))[:, None] / len(units)
        at, g = sums_by(np.concatenate((units, drawn)), np.concatenate((g_out, g_bias), 1))
        self.move(m.out, self.grown[1], at, g[:, :-1])
        self.move(m.bias[:, None], self.grown[2], at, g[:, -1:])
        for j in range(CONTEXT):
            at, g = sums_by(before[:, j], g_h)
            self.move(m.context[j], self.grown[0][j], at, g)
        self.steps += 1

    def over(self, before: np.ndarray, units: np.ndarray, batch: int = BATCH) -> None:
        """Steps over all given rows, in a random order of short stretches."""
        if len(units) <= batch:
            return self.step(before, units)
        starts = self.rng.permutation(-(-len(units) // 64)) * 64
        order = (starts[:, None] + np.arange(64)).ravel()
        order = order[order < len(units)]
        for at in np.array_split(order, -(-len(order) // batch)):
            self.step(before[at], units[at])


def _unit_rows(vocabulary: Vocabulary, texts, least: int = 16 * BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and units of texts, about ``least`` at once."""
    before, units, held = [], [], 0
    for text in texts:
        tail = np.full(CONTEXT, START)
        for words in tokens(text):
            u = np.concatenate((tail, vocabulary.read(words)[1]))
            before.append(np.stack([u[CONTEXT - 1 - j : len(u) - 1 - j] for j in range(CONTEXT)], 1))
            units.append(u[CONTEXT:])
            tail, held = u[-CONTEXT:], held + len(words)
            if held >= least:
                yield np.concatenate(before), np.concatenate(units)
                before, units, held = [], [], 0
    if held:
        yield np.concatenate(before), np.concatenate(units)


def _trained(texts: DataFrame, vocabulary: Vocabulary, start: np.ndarray, warm: bool = False) -> DataFrame:
    """tokens and parameters of each task that has seen any. A ``warm`` task ends after twice ``WARM`` tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LogBilinear(vocabulary.noise).load(start)
        trainer, seen, kept = Trainer(model, vocabulary.noise), 0, []
        for before, units in _unit_rows(vocabulary, (t for b in batches for t in b["text"])):
            if not warm:
                trainer.over(before, units)
            elif seen < 2 * WARM:
                kept.append((before.astype(np.int16), units.astype(np.int16)))
            seen += len(units)
        for _ in range(PASSES * bool(kept)):
            for before, units in kept:
                trainer.over(before.astype(np.int64), units.astype(np.int64), WARM_BATCH)
            if trainer.steps >= STEPS:
                break
        yield pd.DataFrame({"tokens": [seen] if seen else [], "flat": [model.flat().tobytes()] if seen else []})

    return texts.select("text").mapInPandas(run, "tokens long, flat binary")


def _averaged(parts: DataFrame) -> np.ndarray | None:
    """The mean of the tasks' parameters by tokens: groups of tasks first, then their means."""

    def mean(b: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(f, np.float32).astype(float) * n for n, f in zip(b["tokens"], b["flat"], strict=True))
        return pd.DataFrame({"tokens": [b["tokens"].sum()], "flat": [(total / b["tokens"].sum()).astype(np.float32).tobytes()]})

    parts = written(parts.withColumn("task", F.spark_partition_id()), "lm-trained")
    groups = max(1, math.isqrt(parts.count()))
    few = parts.groupBy((F.col("task") % groups).alias("g")).applyInPandas(mean, "tokens long, flat binary").toPandas()
    return np.frombuffer(mean(few)["flat"][0], np.float32) if len(few) else None


def fit(docs: DataFrame, learn: Column) -> tuple[DataFrame, Vocabulary, LogBilinear]:
    """The counts (token, n), the frequent tokens and the model of the documents where ``learn`` holds."""
    small_batches(docs.sparkSession)
    texts = docs.filter(learn).select("doc_id", "text")
    counts = written(count_tokens(texts), "lm-counts")
    vocabulary = learn_vocabulary(counts)
    model = LogBilinear(vocabulary.noise)
    if vocabulary.total:
        share = F.xxhash64(F.lit(12), "doc_id", "text") / F.lit(2.0**64) + 0.5
        sample = written(texts.filter(share < WARM / vocabulary.total).select("text"), "lm-sample")
        warm = _averaged(_trained(sample.coalesce(1), vocabulary, model.flat(), warm=True))
        start = model.flat() if warm is None else warm
        model.load(_averaged(_trained(texts, vocabulary, start)))
    return counts, vocabulary, model


def _scores(docs: DataFrame, vocabulary: Vocabulary, model: LogBilinear, columns: list[str]) -> DataFrame:
    """What a worker knows of each text, and the tokens that it does not know."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 128):
                b, rest = whole.iloc[lo : lo + 128], []
                sums = np.zeros((len(b), 5))  # tokens, known ones, unigram logs, logs within classes, model logs
                before, units, row = [], [], []
                for i, text in enumerate(b["text"]):
                    missing, tail = Counter(), np.full(CONTEXT, START)
                    for words in tokens(text):
                        at, u, unknown = vocabulary.read(words)
                        here = at[at >= 0]
                        missing.update(unknown)
                        logs = vocabulary.log_counts[here]
                        sums[i, :4] += len(words), len(here), logs.sum(), logs[here >= SHORT].sum() - vocabulary.tail[u].sum()
                        u = np.concatenate((tail, u))
                        own = np.stack([u[CONTEXT - 1 - j : len(u) - 1 - j] for j in range(CONTEXT)], 1)
                        if len(words) > PIECE // 16:  # nothing of a long text is held until the batch ends
                            sums[i, 4] += model.log_p(own, u[CONTEXT:]).sum()
                        else:
                            before.append(own)
                            units.append(u[CONTEXT:])
                            row.append(np.full(len(words), i))
                        tail = u[-CONTEXT:]
                    rest.append([{"token": t, "n": n} for t, n in missing.items()])
                if units:
                    sums[:, 4] += np.bincount(np.concatenate(row), model.log_p(np.concatenate(before), np.concatenate(units)), len(b))
                yield b.drop(columns="text").assign(**{c: sums[:, k].astype(t) for k, (c, t) in enumerate(zip(("n_tokens", "known", "uni", "within", "bilinear"), (int, int, float, float, float), strict=True))}, rest=rest)

    small_batches(docs.sparkSession)
    kept = docs.select(*columns, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return kept.mapInPandas(run, f"{schema}, n_tokens long, known long, uni double, within double, bilinear double, rest array<struct<token: binary, n: long>>")


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: LogBilinear) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text) of every document."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").withColumn("row", F.monotonically_increasing_id())
    found = written(_scores(rows, vocabulary, model, ["row", "doc"]), "lm-scores")
    rare = found.select("row", F.explode("rest").alias("r")).select("row", F.col("r.token").alias("token"), F.col("r.n").alias("m"))
    met = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("m"))).alias("met"))
    both = found.drop("rest").join(met, "row", "left")
    more, kind = F.coalesce("more", F.lit(0.0)), docs.schema["doc_id"].dataType
    return both.select(
        F.col("doc").cast(kind).alias("doc_id"), "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("uni") + more - F.col("n_tokens") * vocabulary.base_rest()).alias("base_score"), (F.col("bilinear") + F.col("within") + more).alias("score"),
    )


def held_out(parts: int = 10, part: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == part
