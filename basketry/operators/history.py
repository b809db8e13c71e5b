"""Catalogue state and price history over immutable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions.prices import PRICE_STEP
from basketry.operators.sliding import sliding_median

KNOWN_KEPT = ("brand", "unit", "url", "image", "barcode", "price", "in_stock")
OVERWRITTEN = ("name", "weight_g", "category")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: tuple[str, ...], keep_known: tuple[str, ...]) -> DataFrame:
    """Old rows with the new ones applied: ``overwrite`` columns always, ``keep_known`` only where the new value is known.

    ``action`` tells what became of a row: added, changed, same or untouched (not in the new batch).
    """
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = o.join(n, on, "full_outer")
    is_old, is_new = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()
    value = {c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in overwrite} | {c: F.coalesce(f"n.{c}", f"o.{c}") for c in keep_known}
    same = F.lit(True)
    for c, v in value.items():
        same = same & v.eqNullSafe(F.col(f"o.{c}"))
    action = F.when(~is_old, "added").when(~is_new, "untouched").when(same, "same").otherwise("changed")
    return both.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], *[v.alias(c) for c, v in value.items()], action.alias("action"))


def upsert_catalog(old: DataFrame, new: DataFrame, run_at: Column) -> DataFrame:
    """Upsert by (chain, sku). A changed name resets the item to ``prev_item_id``; ``price_seen`` moves only with a named price."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.chain") == F.col("n.chain")) & (F.col("o.sku") == F.col("n.sku")), "full_outer")
    is_new = F.col("n.sku").isNotNull()
    renamed = is_new & F.col("o.sku").isNotNull() & ~F.col("n.name").eqNullSafe(F.col("o.name"))
    named = F.col("n.price").isNotNull() & ~F.coalesce(F.col("n.price_from_base"), F.lit(False))
    return both.select(
        F.coalesce("o.chain", "n.chain").alias("chain"),
        F.coalesce("o.sku", "n.sku").alias("sku"),
        *[F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in OVERWRITTEN],
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in KNOWN_KEPT],
        F.coalesce("o.first_seen", F.when(is_new, run_at)).alias("first_seen"),
        F.when(is_new, run_at).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(is_new & named, run_at).otherwise(F.col("o.price_seen")).alias("price_seen"),
        (is_new | F.coalesce(F.col("o.active"), F.lit(False))).alias("active"),
        F.when(renamed, F.lit(None).cast("long")).otherwise(F.col("o.item_id")).alias("item_id"),
        F.when(renamed, F.col("o.item_id")).otherwise(F.col("o.prev_item_id")).alias("prev_item_id"),
    )


def touch_seen(catalog: DataFrame, seen: DataFrame, run_at: Column) -> DataFrame:
    """Rows of ``seen`` (chain, sku) are active and seen now; unknown ones are ignored."""
    marked = catalog.join(seen.select("chain", "sku").distinct().withColumn("_seen", F.lit(True)), ["chain", "sku"], "left")
    return marked.withColumn("last_seen", F.when(F.col("_seen"), run_at).otherwise(F.col("last_seen"))).withColumn("active", F.col("active") | F.coalesce("_seen", F.lit(False))).drop("_seen")


def retire_unseen(catalog: DataFrame, chain: str, run_start: Column, complete: bool) -> DataFrame:
    """After a complete run the chain's rows that it did not see sleep; a partial run retires nothing."""
    if not complete:
        return catalog
    gone = (F.col("chain") == chain) & (F.col("last_seen") < run_start)
    return catalog.withColumn("active", F.col("active") & ~gone)


def change_log(prices: DataFrame, keys: list[str], at: list[str], price: str = "price", step: float = PRICE_STEP) -> DataFrame:
    """The first price of every key and each later one that differs from the one before by more than ``step``."""
    before = F.lag(price).over(Window.partitionBy(*keys).orderBy(*at))
    return prices.filter(F.col(price).isNotNull()).withColumn("previous", before).filter(F.col("previous").isNull() | (F.abs(F.col(price) - F.col("previous")) > step))


def new_observations(have: DataFrame, seen: DataFrame, most: float = 1e6) -> DataFrame:
    """Sane observations that are not there yet, one for each (chain, sku, seen_at)."""
    key = ["chain", "sku", "seen_at"]
    return seen.filter((F.col("price") > 0) & (F.col("price") <= most)).dropDuplicates(key).join(have.select(*key), key, "left_anti")


def usual_price(changes: DataFrame, keys: list[str], at: str, price: str = "price", days: int = 30, least: int = 3, old_days: int = 7) -> DataFrame:
    """Beside every change: the upper median of the window's prices, and whether it can be trusted.

    Trusted: three changes in the window, or the oldest of it is a week old. Changes without a time are left out.
    """
    kind = changes.schema[at].dataType
    out = sliding_median(changes, keys, at, price, days * 86400).withColumnRenamed("n", "n_changes")
    out = out.withColumn("oldest", F.timestamp_micros("oldest_us").cast(kind)).drop("oldest_us")
    return out.withColumn("trusted", (F.col("n_changes") >= least) | (F.col(at) >= F.col("oldest") + F.expr(f"INTERVAL {old_days} DAYS")))


def versus_usual(price: Column, usual: Column, share: float = 0.1) -> Column:
    """dear, cheap or usual by a tenth; null without history."""
    return F.when(usual > 0, F.when(price > usual * (1 + share), "dear").when(price < usual * (1 - share), "cheap").otherwise("usual"))


def price_suspect(price: Column, usual: Column) -> Column:
    return F.coalesce((price < usual * 0.33) | (price > usual * 2.0), F.lit(False))


def is_fresh(at: Column, now: Column, hours: float) -> Column:
    return F.coalesce(at >= now - F.make_dt_interval(hours=F.lit(0), mins=F.lit(int(hours * 60))), F.lit(False))


def price_as_of(snapshots: DataFrame, keys: list[str], now: Column, own_point: Column, hours: float = 6) -> DataFrame:
    """The snapshot that counts now: a fresh cart price first, then the person's own point, then the newest.

    A snapshot of another point never counts; what is older than ``hours`` is no price.
    """
    own = F.col("point_key").eqNullSafe(own_point)
    fit = snapshots.filter((F.col("fetched_at") <= now) & (own | F.col("point_key").isNull()))
    cart = (F.col("source") == "cart") & is_fresh(F.col("fetched_at"), now, hours)
    best = latest_by(fit, keys, [F.desc(F.coalesce(cart, F.lit(False))), F.desc(own), F.desc("fetched_at"), F.desc("id")])
    return best.filter(is_fresh(F.col("fetched_at"), now, hours))


def stale_keys(mapped: DataFrame, snapshots: DataFrame, keys: list[str], now: Column, hours: float) -> DataFrame:
    """Mapped keys without a fresh price."""
    fresh = snapshots.filter(is_fresh(F.col("fetched_at"), now, hours)).select(*keys).distinct()
    return mapped.join(fresh, keys, "left_anti")


def note_misses(misses: DataFrame, missed: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Miss counters by (chain, sku): one more for each miss, none for what was found."""
    key = ["chain", "sku"]
    again = missed.select(*key).withColumn("times", F.lit(1)).withColumn("last_miss", now)
    return misses.select(*key, "times", "last_miss").unionByName(again).groupBy(*key).agg(F.sum("times").alias("times"), F.max("last_miss").alias("last_miss")).join(found.select(*key), key, "left_anti")


def close_stale_runs(runs: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    dead = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return runs.withColumn("status", F.when(dead, "failed").otherwise(F.col("status")))


def sleeping(catalog: DataFrame) -> DataFrame:
    """Inactive rows under the item they had."""
    return catalog.filter(~F.col("active")).withColumn("item_id", F.coalesce("item_id", "prev_item_id")).filter("item_id is not null")
