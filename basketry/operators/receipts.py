"""Receipts: ledger, import, resolution of sellers and services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a receipt, the strongest last.
STATES = ("seen", "unavailable", "other_store", "imported")


def ledger(events: DataFrame) -> DataFrame:
    """key, state, since, dates of receipt events (key, state, at): the strongest state wins, of equal ones the latest."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    e = events.withColumn("rank", rank)
    return e.groupBy("key").agg(F.max_by("state", F.struct("rank", "at")).alias("state"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def seller(name: Column, signs: list[tuple[str, str]], not_for: dict[str, list[str]] | None = None) -> Column:
    """The chain of the first sign that a seller's name holds; a chain's exclusion words rule it out."""
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit(None).cast("string")
    for sign, chain in reversed(signs):
        hit = low.contains(sign.lower())
        for word in (not_for or {}).get(chain, []):
            hit = hit & ~low.contains(word.lower())
        out = F.when(hit, chain).otherwise(out)
    return out


def is_service(name: Column) -> Column:
    """Delivery, assembly, subscriptions and the like, unless the name has a sign of goods (a size or a count)."""
    low = F.lower(F.coalesce(name, F.lit("")))
    goods = low.rlike(r"\d\s*(?:г|гр|кг|мл|л|шт)(?![а-я])")
    return ~goods & low.rlike(r"(?iu)доставк|сборк[аи] заказ|сервисн\S+ сбор|подписк|страхов|чаевы|аванс|предоплат|подарочн\S+ карт|пополнени|комисси")


def store_receipts(rows: DataFrame, known: DataFrame, goods_sellers: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to append (receipts that are new and of a grocer), and the ledger events of all new receipts."""
    new = rows.join(known.select("key").distinct(), "key", "left_anti").withColumn("goods", goods_sellers)
    events = new.groupBy("key").agg(F.max("goods").alias("goods"), F.max("date").alias("at")).select("key", F.when(F.col("goods"), "imported").otherwise("other_store").alias("state"), "at")
    return new.filter("goods").drop("goods"), events


def count_by_store(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("store").count().orderBy(F.desc("count"), "store")


def loaded(history: DataFrame) -> DataFrame:
    """Per store, "no store" included: receipts, rows, first and last day, total."""
    return history.groupBy(F.coalesce("store", F.lit("(none)")).alias("store")).agg(F.countDistinct("key").alias("receipts"), F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.round(F.sum("total"), 2).alias("total"))


def raw_names(history: DataFrame, limit: int) -> DataFrame:
    return history.groupBy("raw_name").agg(F.max("day").alias("last_day"), F.count(F.lit(1)).alias("times")).orderBy(F.desc("last_day"), "raw_name").limit(limit)


def name_variants(rows: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Spellings by (item_id, chain, variant): hits grow only on a fresher sight."""
    new = rows.groupBy("item_id", "chain", "variant").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count(F.lit(1)).alias("hits"))
    if previous is None:
        return new
    key = ["item_id", "chain", "variant"]
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in ("first_seen", "last_seen", "hits")])
    both = previous.join(n, key, "full_outer")
    fresher = F.col("n_last_seen") > F.col("last_seen")
    hits = F.when(F.col("hits").isNull(), F.col("n_hits")).when(F.coalesce(fresher, F.lit(False)), F.col("hits") + F.col("n_hits")).otherwise(F.col("hits"))
    return both.select(*key, F.least("first_seen", "n_first_seen").alias("first_seen"), F.greatest("last_seen", "n_last_seen").alias("last_seen"), hits.alias("hits"))


def forget(history: DataFrame, receipts: DataFrame) -> DataFrame:
    return history.join(receipts.select("key"), "key", "left_anti")


def with_state(state_rows: DataFrame, state: str, limit: int | None = None) -> DataFrame:
    """Receipts (key, date, state) of one state, the newest first: pending ones are ``seen``."""
    out = state_rows.filter(F.col("state") == state).orderBy(F.desc("date"), "key")
    return out.limit(limit) if limit else out


def stale_days(state_rows: DataFrame, today: Column) -> DataFrame:
    """Days since the newest imported receipt."""
    return state_rows.filter("state = 'imported'").agg(F.datediff(today, F.max("date")).alias("days"))


def next_steps(state_rows: DataFrame, today: Column, old: int = 14) -> DataFrame:
    """What a person could do, as codes: load (nothing imported), refresh (too old), fetch (receipts wait), retry (some failed)."""
    n = lambda s: F.count_if(F.col("state") == s)
    age = F.datediff(today, F.max(F.when(F.col("state") == "imported", F.col("date"))))
    steps = F.array(F.when(n("imported") == 0, "load"), F.when(age > old, "refresh"), F.when(n("seen") > 0, "fetch"), F.when(n("unavailable") > 0, "retry"))
    return state_rows.agg(F.array_compact(steps).alias("steps"))


def receipt_priced(products: DataFrame, history: DataFrame) -> DataFrame:
    """Products whose usual price a receipt tells."""
    return products.join(history.filter("unit_price > 0").select("product_id"), "product_id", "left_semi")
