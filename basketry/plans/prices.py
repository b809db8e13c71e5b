"""Queries on prices over time and across shops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import prices as p
from basketry.operators import history, market
from basketry.registry import query, table

NOW = "2024-01-31 00:00:00"

OFFERS_SQL = """
    offers AS (SELECT l_partkey AS product, l_suppkey AS shop, floor(min(l_extendedprice / l_quantity) * 100 + 0.5) / 100 AS price
               FROM lineitem GROUP BY 1, 2)"""
SANE_SQL = (
    OFFERS_SQL
    + """,
    med AS (SELECT product, count(*) AS n, list_sort(list(price))[len(list(price)) // 2 + 1] AS m FROM offers GROUP BY product),
    fit AS (SELECT o.*, n, price BETWEEN m * 0.2 AND m * 5 AS ok FROM offers o JOIN med USING (product)),
    sane AS (SELECT * FROM fit f WHERE n < 3 OR ok OR NOT EXISTS (SELECT 1 FROM fit g WHERE g.product = f.product AND g.ok))"""
)


def cents(value: Column, digits: int = 2) -> Column:
    """Rounded by the same double arithmetic in either engine; their ``round`` differs on halves."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, shop, price: each shop's lowest unit price of a product."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("shop")).agg(cents(F.min(unit)).alias("price"))


@query(f"WITH {SANE_SQL} SELECT product, min(price) AS best_price, arg_min(shop, (price, shop)) AS best_shop, count(*) AS n_offers FROM sane GROUP BY product")
def cheapest_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.cheapest(offers(spark, sf_dir), ["product"], "shop")


@query(
    f"""WITH {SANE_SQL} SELECT product, min(price) AS low, max(price) AS high, count(*) AS n, round(max(price) - min(price), 2) AS diff,
    floor(1000 * (max(price) - min(price)) / min(price) + 0.5) / 10 AS pct FROM sane GROUP BY product HAVING count(*) >= 2"""
)
def offer_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.spread(offers(spark, sf_dir), ["product"])


@query(f"WITH {SANE_SQL} SELECT product, shop, price FROM fit WHERE (product, shop) NOT IN (SELECT product, shop FROM sane)")
def price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.with_sanity(offers(spark, sf_dir), ["product"]).filter(~F.col("sane")).select("product", "shop", "price")


@query(f"WITH {SANE_SQL} SELECT product, min(price) AS sane_min FROM sane GROUP BY product")
def sane_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a product's rows move once, as numbers: its offers and their least are both found where they have met
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("shop"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    least = li.repartition("product").groupBy("product", "shop").agg(cents(F.min("unit")).alias("price"))
    return least.groupBy("product").agg(p.sane_min(F.collect_list("price")).alias("sane_min"))


@query(f"WITH {OFFERS_SQL} SELECT shop, count(*) AS products, count_if(price < 1000) AS cheap, floor(sum(CAST(round(price * 100) AS BIGINT)) / count(*) * 100 + 0.5) / 10000 AS mean FROM offers GROUP BY shop")
def price_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).groupBy("shop").agg(F.count("price").alias("products"), F.count_if(F.col("price") < 1000).alias("cheap"), (F.floor(F.sum(F.round(F.col("price") * 100).cast("long")) / F.count("price") * 100 + 0.5) / 10000).alias("mean"))


@query(
    """SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""
)
def latest_price_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return history.latest_by(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(
    f"""WITH s AS (SELECT user_id, event_type, event_id, ts, value, user_id % 3 AS point, event_id % 4 = 0 AS cart,
                          ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AS fresh
                   FROM events WHERE ts <= TIMESTAMP '{NOW}' AND event_id % 3 IN (0, 1))
    , r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
            ORDER BY (cart AND fresh) DESC, event_id % 3 = 0 DESC, ts DESC, event_id DESC) AS rn FROM s)
    SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1 AND fresh"""
)
def price_with_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of points 0, 1 and none (events by id): own point is 0, every fourth snapshot is of a cart."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 3 == 0, "own").when(F.col("event_id") % 3 == 2, "other")
    s = e.select("user_id", "event_type", F.col("event_id").alias("id"), "value", F.col("ts").alias("fetched_at"), key.alias("point_key"), F.when(F.col("event_id") % 4 == 0, "cart").otherwise("feed").alias("source"))
    now = F.lit(NOW).cast("timestamp_ntz") if s.schema["fetched_at"].dataType.typeName() == "timestamp_ntz" else F.lit(NOW).cast("timestamp")
    return history.price_as_of(s, ["user_id", "event_type"], now, F.lit("own"), 48).select("user_id", "event_type", F.col("id").alias("event_id"), "value")


CHANGES_SQL = """
    c AS (SELECT user_id, event_type, event_id, ts, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events WHERE value IS NOT NULL),
    ch AS (SELECT * FROM c WHERE previous IS NULL OR abs(value - previous) > 0.004)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return history.change_log(e, ["user_id", "event_type"], ["ts", "event_id"], "value")


@query(f"WITH {CHANGES_SQL} SELECT user_id, event_type, event_id, value, previous FROM ch")
def price_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("user_id", "event_type", "event_id", "value", "previous")


USUAL_SQL = (
    CHANGES_SQL
    + """,
    w AS (SELECT *, floor(epoch(ts)) AS sec FROM ch),
    u AS (SELECT user_id, event_type, event_id, value, list_sort(list(value) OVER g)[len(list(value) OVER g) // 2 + 1] AS usual,
                 count(*) OVER g AS n_changes, count(*) OVER g >= 3 OR ts >= min(ts) OVER g + INTERVAL 7 DAY AS trusted
          FROM w WINDOW g AS (PARTITION BY user_id, event_type ORDER BY sec RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW))"""
)


@query(f"WITH {USUAL_SQL} SELECT * FROM u")
def usual_price_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = history.usual_price(changes(spark, sf_dir), ["user_id", "event_type"], "ts", "value")
    return u.select("user_id", "event_type", "event_id", "value", "usual", "n_changes", "trusted")


@query(
    f"""WITH {USUAL_SQL} SELECT user_id, event_type, event_id,
        CASE WHEN usual > 0 THEN CASE WHEN value > usual * 1.1 THEN 'dear' WHEN value < usual * 0.9 THEN 'cheap' ELSE 'usual' END END AS note,
        value < usual * 0.33 OR value > usual * 2.0 AS suspect FROM u"""
)
def versus_usual(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = history.usual_price(changes(spark, sf_dir), ["user_id", "event_type"], "ts", "value")
    return u.select("user_id", "event_type", "event_id", history.versus_usual(F.col("value"), F.col("usual")).alias("note"), history.price_suspect(F.col("value"), F.col("usual")).alias("suspect"))


@query(
    """SELECT l_partkey AS product, arg_max(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100, (l_shipdate, -l_extendedprice / l_quantity)) AS price, max(l_shipdate)::DATE AS day
    FROM lineitem GROUP BY l_partkey"""
)
def last_price_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("product")).agg(F.max_by(cents(unit), F.struct("l_shipdate", (-unit).alias("u"))).alias("price"), F.max("l_shipdate").cast("date").alias("day"))


@query(
    f"""SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN
    (SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR AND ts IS NOT NULL)"""
)
def stale_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("fetched_at"))
    keys = ["user_id", "event_type"]
    return history.stale_keys(e.select(*keys).distinct(), e, keys, F.lit(NOW).cast("timestamp"), 72)


@query(
    f"""SELECT user_id, event_type, max(ts) AS last_seen FROM events GROUP BY ALL
    HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 20 HOUR ORDER BY last_seen, user_id, event_type LIMIT 50"""
)
def freshness_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 stalest keys past the age floor: what a refresh asks for first."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_seen"))
    return e.filter(F.col("last_seen").cast("timestamp") < F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 20 HOURS")).orderBy("last_seen", "user_id", "event_type").limit(50)


@query(
    """SELECT DISTINCT event_type AS chain, user_id AS sku, ts::DATE AS seen_at FROM events WHERE value > 0 AND value <= 1e6 AND event_id % 10 < 7
       AND (event_type, user_id, ts::DATE) NOT IN (SELECT event_type, user_id, ts::DATE FROM events WHERE event_id % 10 >= 7)"""
)
def new_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sane prices of days that have none yet: three tenths of the events are there already."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("chain"), F.col("user_id").alias("sku"), F.col("ts").cast("date").alias("seen_at"), F.col("value").alias("price"))
    return history.new_observations(e.filter("event_id % 10 >= 7"), e.filter("event_id % 10 < 7")).select("chain", "sku", "seen_at")


@query(
    """SELECT p_partkey AS product, round(CASE WHEN p_size % 5 = 0 THEN p_retailprice ELSE p_retailprice * 1000.0 / (p_size * 100) END, 2) AS value, 'kg' AS label
    FROM part"""
)
def unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth size is sold by weight; a size counts hundreds of grams."""
    u = p.per_unit_price(F.col("p_retailprice"), F.when(F.col("p_size") % 5 == 0, "kg").otherwise("pcs"), F.col("p_size") * 100.0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), u.alias("u")).select("product", "u.value", "u.label")


@query(
    """SELECT event_type, date_trunc('day', ts)::DATE AS day, round(min(value), 2) AS low, round(avg(value), 2) AS mean, round(max(value), 2) AS high, count(*) AS n
    FROM events GROUP BY 1, 2"""
)
def daily_price_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return g.agg(F.round(F.min("value"), 2).alias("low"), F.round(F.avg("value"), 2).alias("mean"), F.round(F.max("value"), 2).alias("high"), F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").cast("date").alias("day"), "low", "mean", "high", "n")
