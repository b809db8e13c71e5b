"""Price observations as a stream: the batch operators, applied batch by batch or by keyed state."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basketry.functions.prices import PRICE_STEP
from basketry.operators.history import upsert_catalog

#: Columns of a catalogue that starts empty.
CATALOG = (
    "chain string, sku string, name string, weight_g double, category string, brand string, unit string, url string, image string, barcode string, "
    "price double, in_stock boolean, first_seen timestamp, last_seen timestamp, price_seen timestamp, active boolean, item_id long, prev_item_id long"
)


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """One observation for each (chain, sku, seen_at); what comes later than the delay is dropped from this stream only."""
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["chain", "sku", "seen_at"])


class ChangeLog(StatefulProcessor):
    """The change log of one key in the order of event time, whatever order its sights come in.

    State: the sights of the last ``delay`` before the newest one, and the sight before them. A sight that comes late, but within
    the delay, takes its place among them: changes that are wrong now are retracted and the right ones added. A sight older than
    that is written as ``late`` and moves nothing. So memory is bounded by the sights of one delay.
    """

    def __init__(self, delay_us: int):
        self.delay_us = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "us long, price double")
        self.sights = handle.getListState("sights", "us long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base = tuple(self.base.get()) if self.base.exists() else None
        held = [tuple(s) for s in self.sights.get()]
        came = [(int(at.value // 1000), float(p)) for b in rows for at, p in zip(b["seen_at"].astype("datetime64[ns]"), b["price"], strict=True) if not pd.isna(p) and not pd.isna(at)]
        newest = max((us for us, _ in [*held, *came, *([base] if base else [])]), default=0)
        # what this batch brings counts as on time against what was there before it
        horizon = max((us for us, _ in [*held, *([base] if base else [])]), default=-(1 << 62)) - self.delay_us
        late = [s for s in came if s[0] < horizon or (base is not None and s <= base)]
        now = sorted([*held, *(s for s in came if not (s[0] < horizon or (base is not None and s <= base)))])
        was, is_ = Counter(_changes(base, held)), Counter(_changes(base, now))
        out = [("retract", *c) for c in (was - is_).elements()] + [("add", *c) for c in (is_ - was).elements()] + [("late", *s, None) for s in late]
        old = [s for s in now if s[0] < newest - self.delay_us]
        if old:
            base = old[-1]
            self.base.update(base)
        self.sights.put(now[len(old) :]) if now[len(old) :] else self.sights.clear()
        times = pd.to_datetime([us for _, us, _, _ in out], unit="us")
        yield pd.DataFrame({"chain": key[0], "sku": key[1], "op": [o for o, *_ in out], "price": [p for _, _, p, _ in out], "seen_at": times, "previous": pd.array([q for *_, q in out], "Float64")})

    def close(self) -> None:
        pass


def _changes(base: tuple[int, float] | None, sights: list[tuple[int, float]]) -> list[tuple[int, float, float | None]]:
    """(time, price, price before) wherever a sight differs from the one before it."""
    out, before = [], base and base[1]
    for us, price in sights:
        if before is None or abs(price - before) > PRICE_STEP:
            out.append((us, price, before))
        before = price
    return out


def _us(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


def change_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """chain, sku, op, price, seen_at, previous: what a stream (chain, sku, price, seen_at) adds to the change log, retracts from it, or brings too late.

    Needs the RocksDB state store. :func:`change_table` gives the log that the rows so far amount to.
    """
    schema = "chain string, sku string, op string, price double, seen_at timestamp, previous double"
    return stream.select("chain", "sku", "price", "seen_at").groupBy("chain", "sku").transformWithStateInPandas(ChangeLog(_us(delay)), schema, "Append", "None")


def change_table(written: DataFrame) -> DataFrame:
    """The change log that the rows of a :func:`change_stream` amount to: added and not retracted."""
    keys = ["chain", "sku", "price", "seen_at", "previous"]
    n = F.sum(F.when(F.col("op") == "add", 1).when(F.col("op") == "retract", -1).otherwise(0))
    left = written.groupBy(*keys).agg(n.alias("n")).filter("n > 0")
    return left.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


class LivingFact(StatefulProcessor):
    """A fact that ends by itself: beside each row, what the key's last fact was if it still lives."""

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fact = handle.getValueState("fact", "price double, us long", self.lifetime_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("seen_at")
        state = self.fact.get() if self.fact.exists() else None
        known, out = (state[0] if state else None), []
        for r in got.itertuples():
            out.append((*key, r.price, r.seen_at, known))
            known = known if pd.isna(r.price) else float(r.price)
            if not pd.isna(r.price):
                self.fact.update((known, int(r.seen_at.value // 1000)))
        yield pd.DataFrame(out, columns=["chain", "sku", "price", "seen_at", "known"]).astype({"known": "Float64"})

    def close(self) -> None:
        pass


def living_prices(stream: DataFrame, lifetime: str = "6 hours") -> DataFrame:
    """Every sight (chain, sku, price, seen_at) with ``known``, the price that was still alive when it came; null asks for a refresh.

    A price lives for ``lifetime`` of processing time after it was written; the state store lets it go by itself.
    """
    schema = "chain string, sku string, price double, seen_at timestamp, known double"
    return stream.select("chain", "sku", "price", "seen_at").groupBy("chain", "sku").transformWithStateInPandas(LivingFact(_us(lifetime) // 1000), schema, "Append", "ProcessingTime")


def windowed_prices(stream: DataFrame, length: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Least, mean and highest price of each chain and SKU by tumbling windows."""
    s = stream.withWatermark("seen_at", delay)
    return s.groupBy(F.window("seen_at", length).alias("w"), "chain", "sku").agg(F.min("price").alias("low"), F.avg("price").alias("mean"), F.max("price").alias("high"), F.count(F.lit(1)).alias("n"))


def crawl_sessions(stream: DataFrame, gap: str = "60 minutes", delay: str = "2 hours") -> DataFrame:
    return stream.withWatermark("started_at", delay).groupBy(F.session_window("started_at", gap).alias("night"), "chain").agg(F.count(F.lit(1)).alias("runs"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue that :func:`upsert_sink` keeps at ``path``."""
    return spark.read.parquet(f"{path}/rows").drop("bucket")


def write_catalog(catalog: DataFrame, path: str, buckets: int = 256) -> None:
    """A first catalogue, dealt to ``buckets`` partitions by a hash of chain and SKU."""
    catalog.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("chain", "sku"), F.lit(buckets)).cast("int")


def upsert_changed(batch: DataFrame, path: str, n: int, run_at: Column, buckets: int = 256) -> None:
    """Upsert one batch into the catalogue at ``path``: only partitions that it touches are read and written again.

    The new partitions are made beside the catalogue first and then replace the old ones at once. A batch that has been
    committed is not applied again, and one that broke off in between is: applying it twice gives what once gives. Rows of
    the catalogue's first batch need not exist before.
    """
    spark, done = batch.sparkSession, f"{path}/commits/{n}"
    if _exists(spark, done):
        return
    new = batch.dropDuplicates(["chain", "sku"]).withColumn("bucket", _bucket(buckets))
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
    if _exists(spark, f"{path}/rows"):
        old = spark.read.parquet(f"{path}/rows").filter(F.col("bucket").isin(touched)).drop("bucket")
    else:
        old = spark.createDataFrame([], CATALOG)
    after = upsert_catalog(old, new.drop("bucket"), run_at).withColumn("bucket", _bucket(buckets))
    staged = f"{path}/staged/{n}"
    after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    if touched:
        ready = spark.read.schema(after.schema).parquet(staged)
        ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    spark.range(1).write.mode("overwrite").parquet(done)


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, run_at: Column, trigger: dict | None = None, buckets: int = 256):
    """Each micro-batch is upserted into the catalogue at ``path``; see :func:`upsert_changed`."""

    def apply(batch: DataFrame, n: int) -> None:
        upsert_changed(batch, path, n, run_at, buckets)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
