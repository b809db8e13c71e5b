"""Exact deduplication with a log-structured merge index of text digests.

Every scan task is a memtable: it flushes its documents' entries (digest, key, identifier)
sorted by digest; tasks are dealt to ``memtables`` runs, and each batch of documents flushes
runs of its own. When a level holds ``fanout`` runs they are merged into one run of the next
level, with one entry a digest (and key) that keeps the smallest identifier (or the largest) and the
count. An entry that several rows share is a hit.

Hits receive byte verification: their texts are grouped by the bytes themselves, so two texts
that only share digest and key never count as copies. Filters keep all other texts where they are. A
filter is a bitmap over the entries' 64-bit keys, of ``MOST_BITS`` bits at most and therefore
broadcast; the scan tests each text's key against the bitmap of the hits, and only what passes
is shuffled. A filter that fills up lets more texts pass and changes no result.
:meth:`DigestIndex.probe` asks each run's filter before it joins the run.

Only DataFrame operations run. Compaction and verification aggregate before their shuffle, so a
group of copies sends one entry from each task; look-ups are equi-joins of two stored tables,
which adaptive execution splits where a digest is hot.

Defined cases: a null text counts as empty; texts are equal when equal after lower-casing
A-Z only; a null ``doc_id`` stays only in a group that has no other identifier; rows that
repeat a document (same id and text) are each reported, and :func:`drop_copies` keeps one
of them; an empty table gives an empty result; further columns are ignored by
:func:`find_copies` and kept by :func:`drop_copies`; how documents are dealt to batches and
runs changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.workspace import ascii_lower, free_name, new_path, written

#: Runs that a batch is flushed to, and runs of a level that are merged into the next.
MEMTABLES, FANOUT = 8, 8
#: Bits of a filter: so many a key, rounded up to a power of two, and at most so many (16 MiB).
BITS_A_KEY, MOST_BITS = 16, 2**27
#: Bits of one row of a filter, fixed by ``bitmap_construct_agg``.
ROW_BITS = 32768

#: What identifies an entry, and its columns.
SAME = ["digest", "key"]
ENTRY = "digest binary, key long, keep_id long, n long"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: str = "text") -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


@dataclass
class KeyFilter:
    """A bitmap over 64-bit keys, as rows (at, bits) of ``ROW_BITS`` bits: never misses a key that it was made of."""

    rows: DataFrame
    size: int

    @staticmethod
    def of(keys: DataFrame, most_bits: int = MOST_BITS) -> KeyFilter:
        """``keys`` has a column ``key``."""
        size = max(ROW_BITS, min(most_bits, 2 ** math.ceil(math.log2(BITS_A_KEY * keys.count() + 1))))
        place = F.pmod("key", F.lit(size))
        rows = keys.select(F.floor(place / ROW_BITS).alias("at"), (place % ROW_BITS).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
        return KeyFilter(written(rows, "dedup-filter"), size)

    def marked(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a boolean column ``name``: whether the row's key may be one of the filter's."""
        place = F.pmod(key, F.lit(self.size))
        f = F.broadcast(self.rows).select(F.col("at").alias(f"{name}_at"), F.col("bits").alias(f"{name}_bits"))  # MOST_BITS / 8 bytes at most
        bit = (place % ROW_BITS).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit % 8)) != 0, F.lit(False))
        return df.join(f, F.floor(place / ROW_BITS) == F.col(f"{name}_at"), "left").withColumn(name, hit).drop(f"{name}_at", f"{name}_bits")


@dataclass
class Run:
    level: int
    path: str
    keys: KeyFilter | None = None


class DigestIndex:
    """Sorted digest runs in levels below one shared path."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest", digest: Callable[[Column], Column] = sha256, key: Callable[[Column], Column] = F.xxhash64, memtables: int = MEMTABLES, fanout: int = FANOUT):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is smallest or largest")
        self.spark, self.path, self.digest, self.key, self.memtables, self.fanout = spark, path, digest, key, memtables, fanout
        self.chosen = F.min if keep == "smallest" else F.max
        self.runs: list[Run] = []
        self.logs: list[str] = []
        self._made = 0

    def _new(self, level: int) -> str:
        self._made += 1
        return f"{self.path}/level{level}-{self._made}"

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*paths)

    def flush(self, docs: DataFrame) -> None:
        """Add a batch (doc_id, text): each task sorts and writes its own entries, nothing moves. Merges the levels that are full."""
        norm = normalised()
        entries = docs.select(self.digest(norm).alias("digest"), self.key(norm).alias("key"), F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        base = self._new(0)
        entries.withColumn("run", F.spark_partition_id() % self.memtables).sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(base)
        # one row a run that was written
        paths = [f"{base}/run={r['run']}" for r in self.spark.read.schema(f"{ENTRY}, run int").parquet(base).select("run").distinct().orderBy("run").collect()]
        self.logs += paths
        self.runs += [Run(0, p) for p in paths]
        level = 0
        while sum(r.level == level for r in self.runs) >= self.fanout:
            self._merge([r for r in self.runs if r.level == level], level + 1)
            level += 1

    def _merge(self, runs: list[Run], level: int) -> None:
        merged = self._read([r.path for r in runs]).groupBy(*SAME).agg(self.chosen("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        path = self._new(level)
        merged.sortWithinPartitions(*SAME).write.parquet(path)
        self.runs = [r for r in self.runs if r not in runs] + [Run(level, path)]
        self.runs.sort(key=lambda r: -r.level)

    def compact(self) -> DataFrame:
        """Merge all runs; one entry a digest: digest, key, keep_id and n."""
        if len(self.runs) > 1 or any(r.level == 0 for r in self.runs):
            self._merge(self.runs, max(r.level for r in self.runs) + 1)
        return self.entries()

    def entries(self) -> DataFrame:
        """The entries of all runs; a digest has one in each run that holds it (in a run of level 0, one a row)."""
        return self._read([r.path for r in self.runs]) if self.runs else self.spark.createDataFrame([], ENTRY)

    def documents(self) -> DataFrame:
        """doc_id, digest and key of every row that was flushed."""
        return (self._read(self.logs) if self.logs else self.spark.createDataFrame([], ENTRY)).select(F.col("keep_id").alias("doc_id"), *SAME)

    def probe(self, docs: DataFrame) -> DataFrame:
        """doc_id and digest of the rows whose text's entry the index holds; each run's filter goes first."""
        norm = normalised()
        batch = docs.select("doc_id", self.key(norm).alias("key"), norm.alias("norm"))
        found = self.spark.createDataFrame([], "doc_id long, digest binary")
        for run in self.runs:
            own = self._read([run.path])
            run.keys = run.keys or KeyFilter.of(own.select("key"))
            asked = run.keys.marked(batch, F.col("key"), "_asked").filter("_asked").select(F.col("doc_id").cast("long").alias("doc_id"), "key", self.digest(F.col("norm")).alias("digest"))
            found = found.unionByName(asked.join(own.select(*SAME), SAME, "left_semi").select("doc_id", "digest"))
        return found.distinct()


def find_copies(docs: DataFrame | list[DataFrame], keep: str = "smallest", digest: Callable[[Column], Column] = sha256, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row a document, of one table or of batches: doc_id, keep_id, group_size, kept, digest (binary)."""
    batches = docs if isinstance(docs, list) else [docs]
    spark = batches[0].sparkSession
    index = DigestIndex(spark, new_path(spark, "dedup-lsm"), keep, digest, key)
    for batch in batches:
        index.flush(batch.select("doc_id", "text"))
    hits = written(index.compact().filter("n > 1"), "dedup-hits")
    if hits.isEmpty():
        groups, torn = hits, None
    else:
        keys = KeyFilter.of(hits.select("key"))
        texts = []
        for batch in batches:
            rows = batch.select("doc_id", normalised().alias("norm"))
            passed = keys.marked(rows, key(F.col("norm")), "_hit").filter("_hit").select("doc_id", "norm", digest(F.col("norm")).alias("digest"), key(F.col("norm")).alias("key"))
            texts.append(passed.join(hits.select(*SAME), SAME, "left_semi"))
        every = texts[0]
        for t in texts[1:]:
            every = every.unionByName(t)
        by_text = every.groupBy(*SAME, "norm").agg(index.chosen("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        counts = written(by_text.select(*SAME, "keep_id", "n"), "dedup-verified")
        torn = written(counts.groupBy(*SAME).count().filter("count > 1").select(*SAME), "dedup-torn")
        torn, groups = (None, hits) if torn.isEmpty() else (torn, hits.join(torn, SAME, "left_anti"))
    entries = index.documents()
    if torn is not None:
        entries = entries.join(torn, SAME, "left_anti")
    found = entries.join(groups.select(*SAME, "keep_id", "n"), SAME, "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "digest"
    )
    if torn is not None:  # different texts behind one entry: the text itself is the key
        mixed = every.join(torn, SAME, "left_semi")
        by_text = mixed.groupBy(*SAME, "norm").agg(index.chosen("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.unionByName(mixed.join(by_text, [*SAME, "norm"]).select("doc_id", "keep_id", "group_size", "digest"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "group_size", "kept", "digest")


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns; one row of those that repeat an id and a text. Only texts of hits move."""
    found = written(find_copies(docs, keep).filter("group_size > 1"), "dedup-found")
    if found.isEmpty():
        return docs
    key, mark, own = (free_name(docs, c) for c in ("_key", "_mark", "_own"))
    keyed = written(found.select("digest").distinct(), "dedup-digests")
    norm = normalised()
    first8 = lambda d: F.conv(F.hex(F.substring(d, 2, 7)), 16, 10).cast("long")  # noqa: E731  56 bits of the digest
    keys = KeyFilter.of(keyed.select(first8(F.col("digest")).alias("key")))
    hashed = docs.withColumn(own, sha256(norm))
    asked = keys.marked(hashed.withColumn(key, first8(F.col(own))), F.col(key), mark)
    rest = asked.filter(~F.col(mark))
    gone = found.filter("not kept").select("doc_id", "digest").distinct()
    d, g = asked.filter(mark).alias("d"), gone.alias("g")
    left = d.join(g, (F.col(f"d.{own}") == F.col("g.digest")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti")
    if not found.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", own])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rest.select(*columns).unionByName(left.select(*columns))
