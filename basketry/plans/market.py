"""Queries on mappings, coverage, chains and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.prices import half_up, point_key
from basketry.functions.text import placeholder_sku
from basketry.operators import carts, health, market
from basketry.registry import query, table


@query("SELECT l_partkey AS product, count(DISTINCT l_suppkey) AS shops, max(CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END) AS even_shop, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY l_partkey")
def mapping_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("product")).agg(F.countDistinct("l_suppkey").alias("shops"), F.max((F.col("l_suppkey") % 2 == 0).cast("int")).alias("even_shop"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"))


@query(
    """SELECT item, shop FROM (SELECT DISTINCT l_partkey AS item FROM lineitem), (SELECT s_suppkey AS shop FROM supplier) s
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = item AND l_suppkey = shop)"""
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every shop does not know of all baskets' items."""
    li = table(spark, sf_dir, "lineitem")
    shops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shop"))
    return market.missing_pairs(li.select(F.col("l_partkey").alias("item")), shops, li.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("shop")))


@query("SELECT l_partkey AS item_id, count(DISTINCT l_returnflag) AS chains, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS names FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 2")
def comparable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("chain"), F.col("l_extendedprice").alias("price"), F.lit(True).alias("active"))
    out = market.comparable_items(li)
    return out.withColumn("names", F.array_join(F.array_sort(F.split("names", ",")), ","))


@query(
    """WITH c AS (SELECT l_partkey AS item_id, l_returnflag || l_linestatus AS chain, CASE WHEN (l_orderkey + l_suppkey) % 16 = 0 THEN l_extendedprice END AS price FROM lineitem)
    SELECT DISTINCT item_id, chain FROM c WHERE price IS NULL AND item_id IN (SELECT item_id FROM c WHERE price IS NOT NULL GROUP BY 1 HAVING count(DISTINCT chain) = 1)
    AND (item_id, chain) NOT IN (SELECT item_id, chain FROM c WHERE price IS NOT NULL)"""
)
def waiting_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live listings of items that one chain prices alone, of the chains that are waited for."""
    li = table(spark, sf_dir, "lineitem")
    price = F.when((F.col("l_orderkey") + F.col("l_suppkey")) % 16 == 0, F.col("l_extendedprice"))
    return market.waiting_comparisons(li.select(F.col("l_partkey").alias("item_id"), F.concat("l_returnflag", "l_linestatus").alias("chain"), price.alias("price"), F.lit(True).alias("active")))


@query(
    """SELECT event_type AS chain, count(*) AS rows, count_if(value IS NOT NULL) AS active, count_if(value > 50) AS priced,
    count_if(event_id % 2 = 0) AS stocked, count_if(user_id % 3 = 0) AS coded, count_if(user_id % 5 = 0) AS matched FROM events WHERE value IS NOT NULL GROUP BY 1"""
)
def chain_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value is not null")
    c = e.select(F.col("event_type").alias("chain"), F.lit(True).alias("active"), F.when(F.col("value") > 50, F.col("value")).alias("price"), (F.col("event_id") % 2 == 0).alias("in_stock"),
                 F.when(F.col("user_id") % 3 == 0, F.lit("c")).alias("gtin"), F.when(F.col("user_id") % 5 == 0, F.col("user_id")).alias("item_id"))
    return market.chain_counts(c)


MAPPINGS_SQL = """
    m AS (SELECT l_partkey AS product_id, l_returnflag AS chain, l_linenumber % 2 = 0 AS confirmed, max(l_shipdate) AS confirmed_at, l_suppkey AS id
          FROM lineitem GROUP BY ALL)"""


@query(f"WITH {MAPPINGS_SQL} SELECT product_id, chain, id FROM m QUALIFY row_number() OVER (PARTITION BY product_id, chain ORDER BY confirmed DESC, confirmed_at DESC, id DESC) = 1")
def best_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("chain"), (F.col("l_linenumber") % 2 == 0).alias("confirmed"), F.col("l_suppkey").alias("id")).agg(F.max("l_shipdate").alias("confirmed_at"))
    return market.best_mapping(m).select("product_id", "chain", "id")


@query(
    """WITH pairs AS (SELECT DISTINCT l_partkey AS product_id, l_returnflag AS chain, l_suppkey AS sku FROM lineitem),
    cur AS (SELECT *, sku % 3 = 0 AS confirmed, CASE WHEN sku % 2 = 0 THEN 'human' ELSE 'master' END AS method FROM pairs WHERE sku % 4 = 0),
    rej AS (SELECT product_id, chain, sku FROM pairs WHERE sku % 7 = 0),
    prop AS (SELECT *, false AS confirmed, 'master' AS method FROM pairs WHERE sku % 5 = 0)
    SELECT product_id, chain, sku, method FROM cur
    UNION ALL SELECT product_id, chain, sku, method FROM prop p
    WHERE (product_id, chain, sku) NOT IN (SELECT * FROM rej) AND (product_id, chain, sku) NOT IN (SELECT product_id, chain, sku FROM cur)
      AND (product_id, chain) NOT IN (SELECT product_id, chain FROM cur WHERE confirmed AND method <> 'master')"""
)
def confirm_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("chain"), F.col("l_suppkey").alias("sku")).distinct()
    cur = pairs.filter("sku % 4 = 0").withColumns({"confirmed": F.col("sku") % 3 == 0, "method": F.when(F.col("sku") % 2 == 0, "human").otherwise("master")})
    prop = pairs.filter("sku % 5 = 0").withColumns({"confirmed": F.lit(False), "method": F.lit("master")})
    return market.confirm_mappings(cur, prop, pairs.filter("sku % 7 = 0")).select("product_id", "chain", "sku", "method")


CATALOG_SQL = """
    cat AS (SELECT l_partkey % 97 AS item_id, l_returnflag || l_linestatus AS chain, l_partkey AS sku, max(CASE WHEN l_partkey % 3 > 0 OR l_suppkey % 2 = 0 THEN l_extendedprice END) AS price
            FROM lineitem GROUP BY ALL)"""


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    price = F.when((F.col("l_partkey") % 3 > 0) | (F.col("l_suppkey") % 2 == 0), F.col("l_extendedprice"))
    g = li.groupBy((F.col("l_partkey") % 97).alias("item_id"), F.concat("l_returnflag", "l_linestatus").alias("chain"), F.col("l_partkey").alias("sku"))
    return g.agg(F.max(price).alias("price")).withColumn("active", F.lit(True))


@query(
    f"""WITH {CATALOG_SQL}, bc AS (SELECT item_id, chain, max((price IS NOT NULL)::INT) AS priced FROM cat GROUP BY ALL)
    SELECT item_id, chain, sku, (SELECT count(*) FROM bc b WHERE b.item_id = c.item_id AND b.chain <> c.chain) AS kin,
           (SELECT coalesce(sum(priced), 0) FROM bc b WHERE b.item_id = c.item_id AND b.chain <> c.chain) AS priced_kin
    FROM cat c WHERE price IS NULL ORDER BY priced_kin DESC, kin DESC, sku, chain LIMIT 100"""
)
def refill_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.thin_rows(catalog_rows(spark, sf_dir)).select("item_id", "chain", "sku", "kin", "priced_kin")
    return rows.orderBy(F.desc("priced_kin"), F.desc("kin"), "sku", "chain").limit(100)


@query(
    f"""WITH {CATALOG_SQL} SELECT chain, count(*) AS rows, count_if(price IS NULL) AS gaps, round(count_if(price IS NOT NULL) / count(*), 4) AS priced FROM cat GROUP BY chain"""
)
def price_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(spark, sf_dir).groupBy("chain").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price").isNull()).alias("gaps"), F.round(F.count("price") / F.count(F.lit(1)), 4).alias("priced"))


PLACES_SQL = "pl AS (SELECT s_nationkey AS basket_id, s_suppkey AS place, s_suppkey % 4 AS missing, round(s_acctbal, 2) AS total FROM supplier)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("basket_id"), F.col("s_suppkey").alias("place"), (F.col("s_suppkey") % 4).alias("missing"), F.round("s_acctbal", 2).alias("total"))


@query(
    f"""WITH {PLACES_SQL} SELECT * FROM pl a WHERE NOT EXISTS (SELECT 1 FROM pl b WHERE b.basket_id = a.basket_id AND b.missing <= a.missing
    AND b.total <= a.total AND (b.missing < a.missing OR b.total < a.total))"""
)
def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.dominated(places(spark, sf_dir), ["basket_id"])


@query(
    f"""WITH {PLACES_SQL} SELECT basket_id, place, row_number() OVER w AS rank, round(total - first_value(total) OVER w, 2) AS diff FROM pl
    WINDOW w AS (PARTITION BY basket_id ORDER BY missing, total, place) QUALIFY rank <= 3"""
)
def ranked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.ranked_places(places(spark, sf_dir), ["basket_id"]).select("basket_id", "place", "rank", "diff")


@query(
    """WITH s AS (SELECT s_suppkey AS point, s_nationkey AS chain, 55.0 + (s_suppkey % 100) / 100.0 AS lat, 37.0 + (s_suppkey % 37) / 50.0 AS lon FROM supplier),
    d AS (SELECT *, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 55.75) / 2), 2) + cos(radians(55.75)) * cos(radians(lat)) * pow(sin(radians(lon - 37.62) / 2), 2)))), 6) AS km FROM s)
    SELECT chain, point, round(km, 4) AS km FROM d WHERE km <= 60 QUALIFY row_number() OVER (PARTITION BY chain ORDER BY km, point) = 1"""
)
def nearest_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point"), F.col("s_nationkey").alias("chain"), (F.lit(55.0) + (F.col("s_suppkey") % 100) / 100.0).alias("lat"), (F.lit(37.0) + (F.col("s_suppkey") % 37) / 50.0).alias("lon"))
    return market.nearest(s, F.lit(55.75), F.lit(37.62), ["chain"], within_km=60.0).select("chain", "point", half_up(F.col("km"), 4).alias("km"))


@query("SELECT s_suppkey AS point, printf('%.5f,%.5f', 55.0 + s_suppkey / 7.0, 37.0 + s_suppkey / 11.0) AS key FROM supplier")
def point_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point"), point_key(F.lit(55.0) + F.col("s_suppkey") / 7.0, F.lit(37.0) + F.col("s_suppkey") / 11.0).alias("key"))


@query(
    """SELECT s_suppkey, sku, starts_with(lower(sku), 'hist-') OR starts_with(lower(sku), 'list-') OR starts_with(lower(sku), 'preview-') OR regexp_matches(lower(sku), '-preview-[0-9]')
       OR starts_with(lower(sku), lower(chain) || '-') AS placeholder
    FROM (SELECT s_suppkey, s_name AS chain, CASE s_suppkey % 5 WHEN 0 THEN 'hist-' || s_suppkey WHEN 1 THEN s_name || '-' || s_suppkey WHEN 2 THEN 'x-preview-' || s_suppkey WHEN 3 THEN 'LIST-9' ELSE s_suppkey || '' END AS sku FROM supplier)"""
)
def placeholder_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    sku = F.when(k % 5 == 0, F.concat(F.lit("hist-"), n)).when(k % 5 == 1, F.concat("s_name", F.lit("-"), n)).when(k % 5 == 2, F.concat(F.lit("x-preview-"), n)).when(k % 5 == 3, "LIST-9").otherwise(n)
    return table(spark, sf_dir, "supplier").select("s_suppkey", sku.alias("sku"), placeholder_sku(sku, F.col("s_name")).alias("placeholder"))


@query(
    """SELECT n_name AS nation, r_name AS region, count(DISTINCT l_partkey) AS products, count(*) AS rows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def products_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner joins of mapping, shop and place."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.countDistinct("l_partkey").alias("products"), F.count(F.lit(1)).alias("rows"))


@query(
    """WITH s AS (SELECT *, sum(CASE WHEN epoch(ts) - epoch(prev) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
    FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS runs FROM s GROUP BY ALL"""
)
def crawl_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return health.sessions(e, "ts", ["user_id"]).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("runs"))


@query("SELECT event_type AS chain, arg_max(event_id, event_id) AS last_run, arg_max(user_id, event_id) AS by_user FROM events GROUP BY 1")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), F.col("event_id").alias("id"), "user_id")
    return health.last_run(e).select("chain", F.col("id").alias("last_run"), F.col("user_id").alias("by_user"))


@query(
    """WITH a AS (SELECT event_type AS chain, count(*) AS rows, count_if(value > 80) / count(*) AS priced FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    b AS (SELECT event_type AS chain, count(*) AS rows, count_if(value > 40) / count(*) AS priced FROM events WHERE event_id % 3 > 0 GROUP BY 1)
    SELECT chain, 'rows fell' AS complaint FROM a JOIN b USING (chain) WHERE a.rows < b.rows * 0.8
    UNION ALL SELECT chain, 'priced fell' FROM a JOIN b USING (chain) WHERE a.priced < b.priced * 0.8"""
)
def health_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")

    def snap(rows: DataFrame, over: int) -> DataFrame:
        share = F.count_if(F.col("value") > over) / F.count(F.lit(1))
        return rows.groupBy(F.col("event_type").alias("chain")).agg(F.count(F.lit(1)).alias("rows"), share.alias("priced"), F.lit(1.0).alias("stocked"), F.lit(1.0).alias("matched"))

    return health.complaints(snap(e.filter("event_id % 2 = 0"), 80), snap(e.filter("event_id % 3 > 0"), 40))


@query(
    """SELECT basket_id, product_id, store, CASE WHEN k.p IS NULL THEN 'NOT_KNOWN' WHEN pr.price IS NULL THEN 'NO_DATA' WHEN NOT pr.in_stock THEN 'GONE' ELSE 'HAVE' END AS status
    FROM (SELECT DISTINCT l_orderkey AS basket_id, l_partkey AS product_id FROM lineitem)
    CROSS JOIN (SELECT DISTINCT s_suppkey % 10 AS store FROM supplier)
    LEFT JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey % 10 AS s FROM lineitem) k ON k.p = product_id AND k.s = store
    LEFT JOIN (SELECT l_partkey AS p, l_suppkey % 10 AS s, min(l_extendedprice) AS price, bool_or(l_returnflag <> 'R') AS in_stock FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2) pr ON pr.p = product_id AND pr.s = store"""
)
def item_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    items = li.select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id")).distinct()
    s = li.withColumns({"product_id": F.col("l_partkey"), "store": F.col("l_suppkey") % 10})
    prices = s.filter("l_linestatus = 'O'").groupBy("product_id", "store").agg(F.min("l_extendedprice").alias("price"), F.bool_or(F.col("l_returnflag") != "R").alias("in_stock"))
    stores, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    stores = stores.select((k % 10).alias("store")).distinct()
    return carts.item_status(items, s, prices, stores)


@query(
    """WITH c AS (SELECT c_custkey AS place, (c_custkey * 37 % 1800) / 10.0 - 90 AS lat, (c_custkey * 101 % 3600) / 10.0 - 180 AS lon FROM customer),
    s AS (SELECT s_suppkey AS point, s_nationkey % 3 AS chain, (s_suppkey * 53 % 1800) / 10.0 - 90 AS lat, (s_suppkey * 89 % 3600) / 10.0 - 180 AS lon FROM supplier),
    d AS (SELECT place, chain, point, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(s.lat) - radians(c.lat)) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(c.lon)) / 2), 2)))), 6) AS km FROM c, s)
    SELECT place, chain, point, row_number() OVER w AS rank FROM d WINDOW w AS (PARTITION BY place, chain ORDER BY km, point) QUALIFY rank <= 2"""
)
def nearest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest points of each of three chains for every customer; the SQL measures all pairs."""
    at = lambda k, m, n: ((F.col(k) * m % n) / 10.0 - n / 20.0).cast("double")
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), at("c_custkey", 37, 1800).alias("lat"), at("c_custkey", 101, 3600).alias("lon"))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_nationkey") % 3).alias("chain"), at("s_suppkey", 53, 1800).alias("lat"), at("s_suppkey", 89, 3600).alias("lon"))
    return market.nearest_of_many(places, points, "chain", 2).select("place", "chain", "point", "rank")
