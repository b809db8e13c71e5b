"""Benchmark decontamination by a prefix-filtered join on item windows.

A benchmark item is cut into windows of consecutive words. A document contains a window only
if it contains all its words, so for containment in full the necessary prefix is one word:
the window's rarest, by counts over all documents. Documents are searched for those words
only; an occurrence has to leave room for the window on both sides (the length and positional
bounds), and what remains is verified word by word, in order. The words around an occurrence
travel with it, so no text is joined or shuffled; results are gathered by document row.

Benchmark tables are small beside the corpus, but nothing relies on it: up to ``MOST_WORDS``
words are broadcast for counting and go into the scan as a set, more than that are joined
after counting, and all other joins are left to the optimiser's own size checks.

Defined cases: null or wordless texts have no words and are never contaminated; an item
shorter than a window is one window; equal windows of several items count for each of them;
rows that repeat a document (same id and text) give one result row; rows of one ``doc_id``, or
none, with different texts are documents of their own; empty tables give an empty result or
clean documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.workspace import ascii_lower, free_name, text_keys, written

#: What separates words, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words that the scan of documents holds as a set.
MOST_WORDS = 50_000


def words(text: str = "text") -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), lambda w: w != "")


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, window (array of words), n."""
    items = benchmark.select("item_id", words().alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, width))).alias("window")).withColumn("n", F.size("window")).distinct()


def prefixes(cut: DataFrame, docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """item_id, window, n, word (its rarest in the documents), offset (of that word's first place, from 0)."""
    vocabulary = written(cut.select(F.explode("window").alias("word")).distinct(), "decontam-vocabulary")
    every, n = docs.select(F.explode(words()).alias("word")), F.count(F.lit(1)).alias("df")
    if vocabulary.limit(most_words + 1).count() <= most_words:
        counts = F.broadcast(every.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(n))
    else:  # a row for each word and task is all that moves
        counts = every.groupBy("word").agg(n).join(vocabulary, "word", "left_semi")
    ranked = cut.withColumn("key", F.xxhash64("window")).select("*", F.posexplode("window").alias("offset", "word")).join(counts, "word", "left")
    rarest = F.min_by(F.struct("word", "offset"), F.struct(F.coalesce("df", F.lit(0)), "word", "offset")).alias("rare")
    # a word that no document has cannot match
    return ranked.groupBy("item_id", "window", "n").agg(rarest, F.min(F.coalesce("df", F.lit(0))).alias("df")).filter("df > 0").select("item_id", "window", "n", "rare.word", "rare.offset")


def find(docs: DataFrame, benchmark: DataFrame, width: int = 13, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, key (that of its text), n_words, n_hit, items (sorted strings) for every document."""
    wanted = written(prefixes(windows(benchmark, width), docs, most_words), "decontam-windows")
    rare = written(wanted.select("word").distinct(), "decontam-rare")
    text = docs.select("doc_id", F.array(*text_keys()).alias("key"), words().alias("w"))
    text = text.withColumn("n_words", F.size("w"))
    if rare.limit(most_words + 1).count() <= most_words:
        known = [r["word"] for r in rare.toLocalIterator()]
        spots = F.filter(F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: F.get("w", i).isin(known)) if known else F.array().cast("array<int>")
        spots = F.when(F.col("n_words") > 0, spots)
        near = F.transform(spots, lambda i: F.struct(i.alias("at"), F.get("w", i).alias("word"), F.greatest(i - (width - 1), F.lit(0)).alias("lo"), F.slice(F.col("w"), F.greatest(i - (width - 1), F.lit(0)) + 1, 2 * width - 1).alias("around")))
        spotted = text.select("doc_id", "key", "n_words", F.explode_outer(near).alias("c")).select("doc_id", "key", "n_words", "c.*")
    else:  # any number of rare words: join them to word positions first, then read the neighbourhood
        at = text.select("doc_id", "key", F.posexplode("w").alias("at", "word")).join(rare, "word", "left_semi").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("at")).alias("spots")).alias("a")
        t = text.alias("t")
        joined = t.join(at, F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t.key") == F.col("a.key")), "left").select("t.*", "a.spots")
        near = F.transform("spots", lambda i: F.struct(i.alias("at"), F.get("w", i).alias("word"), F.greatest(i - (width - 1), F.lit(0)).alias("lo"), F.slice(F.col("w"), F.greatest(i - (width - 1), F.lit(0)) + 1, 2 * width - 1).alias("around")))
        spotted = joined.select("doc_id", "key", "n_words", F.explode_outer(near).alias("c")).select("doc_id", "key", "n_words", "c.*")
    pairs = spotted.join(wanted, "word", "left").withColumn("start", F.col("at") - F.col("offset"))
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))
    same = F.slice(F.col("around"), F.greatest(F.col("start") - F.col("lo") + 1, F.lit(1)), F.greatest(F.col("n"), F.lit(0))) == F.col("window")
    hit = F.when(fits & same, F.struct("start", "n", F.col("item_id").cast("string").alias("item")))
    got = pairs.groupBy("doc_id", "key", "n_words").agg(F.collect_set(hit).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))))
    return got.select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"]))).alias("items"))


def contaminated(share: int = 20) -> Column:
    """At least one hit word, and at least one word in ``share``."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The clean documents, with all their columns; a row goes by its id and its text together."""
    gone = written(find(docs, benchmark, width).filter(contaminated()).select("doc_id", "key"), "decontam-gone").alias("g")
    key = free_name(docs, "_key")
    d = docs.withColumn(key, F.array(*text_keys())).alias("d")
    left = d.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{key}") == F.col("g.key")), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
