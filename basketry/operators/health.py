"""The catalogue's health: runs, nights, snapshots and what to complain about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.operators.history import latest_by


def sessions(runs: DataFrame, at: str, keys: list[str] | None = None, gap_minutes: int = 60) -> DataFrame:
    """Runs with the number of their session: a pause of more than the gap starts a new one."""
    w = Window.partitionBy(*(keys or [])).orderBy(at)
    apart = F.col(at).cast("timestamp").cast("double") - F.lag(at).over(w).cast("timestamp").cast("double")
    return runs.withColumn("session", F.sum(F.when(apart > gap_minutes * 60, 1).otherwise(0)).over(w))


def night(runs: DataFrame, at: str = "started_at", gap_minutes: int = 60) -> DataFrame:
    """Start, end and runs of the session with the most runs; of equal ones the later."""
    s = runs.groupBy(F.session_window(at, f"{gap_minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("runs"), F.min(at).alias("first"), F.max(at).alias("last"))
    return s.orderBy(F.desc("runs"), F.desc("first")).limit(1).select("first", "last", "runs")


def last_run(runs: DataFrame) -> DataFrame:
    return latest_by(runs, ["chain"], [F.desc("id")])


def chain_minutes(runs: DataFrame) -> DataFrame:
    done = last_run(runs.filter("status = 'ok'"))
    return done.select("chain", F.round((F.col("finished_at").cast("double") - F.col("started_at").cast("double")) / 60, 1).alias("minutes"))


def fresh_chains(runs: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    return runs.filter((F.col("status") == "ok") & (F.col("finished_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))).select("chain").distinct()


def snapshot(catalog: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Per chain: active rows, share priced, share fresh, share in stock, share matched."""
    on = catalog.filter("active")
    share = lambda c: F.round(F.try_divide(F.count_if(c), F.count(F.lit(1))), 4)
    return on.groupBy("chain").agg(
        F.count(F.lit(1)).alias("rows"), share(F.col("price").isNotNull()).alias("priced"), share(F.coalesce(F.col("price_seen") >= now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))).alias("fresh"),
        share(F.coalesce("in_stock", F.lit(False))).alias("stocked"), share(F.col("item_id").isNotNull()).alias("matched"), F.max("price_seen").alias("last_price"),
    )


def complaints(now: DataFrame, before: DataFrame, fall: float = 0.2) -> DataFrame:
    """chain, complaint: what got worse since the snapshot before."""
    b = before.select("chain", *[F.col(c).alias(f"was_{c}") for c in ("rows", "priced", "stocked", "matched")])
    j = now.join(b, "chain", "full_outer")
    rules = [F.when(F.col("rows").isNull(), "chain is gone"), F.when(F.col("was_rows").isNull(), "chain is new")]
    rules += [F.when(F.col(c) < F.col(f"was_{c}") * (1 - fall), f"{c} fell") for c in ("rows", "priced", "stocked", "matched")]
    return j.select("chain", F.explode(F.array_compact(F.array(*rules))).alias("complaint"))


def phone_rows(catalog: DataFrame, runs: DataFrame, since: Column) -> DataFrame:
    """New rows since a moment, by chain, of chains that no run of ours completed since."""
    ok = runs.filter((F.col("status") == "ok") & (F.col("finished_at") >= since)).select("chain").distinct()
    return catalog.filter(F.col("first_seen") >= since).join(ok, "chain", "left_anti").groupBy("chain").count()


def device_rows(catalog: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows that a window saw first, and older ones that it updated."""
    seen = F.col("last_seen").between(start, end)
    return catalog.filter(seen).withColumn("kind", F.when(F.col("first_seen").between(start, end), "new").otherwise("updated"))


def latest_marks(marks: DataFrame) -> DataFrame:
    """The latest JSON of every key, parsed into a variant."""
    return latest_by(marks, ["key"], [F.desc("at"), F.desc("value")]).withColumn("value", F.try_parse_json("value"))


def sweep_state(marks: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """running, stopped (no sign of life for so long) or done, by sweep (name, started_at, beat_at, finished_at)."""
    late = F.coalesce("beat_at", "started_at") < now - F.expr(f"INTERVAL {hours} HOURS")
    return marks.withColumn("state", F.when(F.col("finished_at").isNotNull(), "done").when(late, "stopped").otherwise("running"))
