"""Queries on lists around items and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import conflicts, prices
from basketry.operators import carts, compare, dictionary, history, market, receipts
from basketry.plans.baskets import LINES_SQL, basket_lines
from basketry.plans.market import PLACES_SQL, catalog_rows, places
from basketry.plans.prices import USUAL_SQL, changes
from basketry.registry import query, table


@query(f"WITH {PLACES_SQL} SELECT * FROM pl a WHERE NOT EXISTS (SELECT 1 FROM pl b WHERE b.basket_id = a.basket_id AND b.missing < a.missing AND b.total <= a.total)")
def partial_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.partly_dominated(places(spark, sf_dir), ["basket_id"])


@query(
    f"""WITH {PLACES_SQL}, e AS (SELECT * FROM pl a WHERE NOT EXISTS (SELECT 1 FROM pl b WHERE b.basket_id = a.basket_id AND b.missing <= a.missing AND b.total <= a.total AND (b.missing < a.missing OR b.total < a.total)))
    SELECT basket_id, place, row_number() OVER w AS rank, round(total - first_value(total) OVER w, 2) AS diff FROM e WINDOW w AS (PARTITION BY basket_id ORDER BY missing, total, place) QUALIFY rank <= 3"""
)
def place_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return compare.board(p.filter("place % 2 = 0"), p.filter("place % 2 = 1")).select("basket_id", "place", "rank", "diff")


@query(
    f"""WITH {LINES_SQL}, b AS (SELECT basket_id, product_id, min(value) AS baseline FROM ln GROUP BY ALL), w AS (SELECT basket_id, sum(baseline) AS whole FROM b GROUP BY 1)
    SELECT basket_id, store AS variant, round(greatest(0, any_value(whole) - sum(baseline)), 2) AS baseline FROM ln JOIN b USING (basket_id, product_id) JOIN w USING (basket_id) GROUP BY ALL"""
)
def covered_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each basket usually costs without what one of its stores has."""
    lines = basket_lines(spark, sf_dir)
    base = lines.groupBy("basket_id", "product_id").agg(F.min("value").alias("baseline"))
    return compare.covered_baseline(base, lines.select("basket_id", "product_id", F.col("store").alias("variant")))


@query("SELECT count(*) AS items, count_if(n > 1) AS shared FROM (SELECT l_partkey % 97 AS item_id, count(DISTINCT l_returnflag || l_linestatus) AS n FROM lineitem GROUP BY 1)")
def item_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.item_totals(catalog_rows(spark, sf_dir))


@query("SELECT l_linestatus AS source, count(*) AS variants, count(DISTINCT l_partkey) AS items, CAST(sum(l_linenumber) AS BIGINT) AS hits FROM lineitem GROUP BY 1")
def variant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.variant_stats(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("source"), F.col("l_partkey").alias("item_id"), F.col("l_linenumber").cast("long").alias("hits")))


@query("SELECT s_nationkey AS store, list_aggregate(list(s_suppkey ORDER BY s_suppkey % 7 DESC, s_suppkey)[1:10], 'string_agg', ',') AS offers FROM supplier GROUP BY 1")
def store_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("store"), F.col("s_suppkey").alias("offer_id"), (F.col("s_suppkey") % 7).alias("percent"))
    return dictionary.offers_map(s).select("store", F.concat_ws(",", F.transform("offers", lambda x: x.cast("string"))).alias("offers"))


@query(
    """SELECT DISTINCT workspace, l_partkey AS product_id FROM (SELECT o_custkey AS workspace, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2)
    JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 3 > 0 AND l_partkey % 7 > 0"""
)
def watched_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each shopper's last two baskets, without those that a fresh price covers or that were asked for already."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("basket_id"), F.col("o_orderdate").alias("created_at"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id"))
    w = dictionary.basket_products(o, items, 2).withColumn("chain", F.lit("a"))
    return dictionary.watch_pass(w, w.filter("product_id % 3 = 0"), w.filter("product_id % 7 = 0")).select("workspace", "product_id")


@query(
    """WITH f AS (SELECT s_suppkey AS offer_id, DATE '2024-01-10' - CAST(s_suppkey % 20 AS INT) AS a, DATE '2024-01-10' + CAST(s_suppkey % 9 AS INT) - 4 AS b, s_suppkey % 3 = 0 AS req, s_suppkey % 2 = 0 AS act, 100.0 AS cap, CAST(s_suppkey % 4 * 50 AS DOUBLE) AS used FROM supplier)
    SELECT offer_id, DATE '2024-01-10' BETWEEN a AND b AND (NOT req OR act) AND cap - used > 0 AS valid FROM f"""
)
def offer_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("s_suppkey"), F.lit("2024-01-10").cast("date")
    v = prices.offer_valid(day, F.date_sub(day, (k % 20).cast("int")), F.date_add(day, (k % 9 - 4).cast("int")), k % 3 == 0, k % 2 == 0, F.lit(100.0), (k % 4 * 50).cast("double"))
    return table(spark, sf_dir, "supplier").select(k.alias("offer_id"), v.alias("valid"))


@query(f"WITH {USUAL_SQL.replace('2592000', '7776000')} SELECT user_id, event_type, event_id, usual, n_changes FROM u")
def usual_price_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.usual_price(changes(spark, sf_dir), ["user_id", "event_type"], "ts", "value", days=90).select("user_id", "event_type", "event_id", "usual", "n_changes")


@query(
    """WITH n AS (SELECT s_suppkey, s_nationkey, 'ООО ' || CASE s_suppkey % 4 WHEN 0 THEN 'АГРОТОРГ' WHEN 1 THEN 'Тандер' WHEN 2 THEN 'Тандер Аптека' ELSE 'Ромашка' END AS name FROM supplier)
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS chain FROM n"""
)
def seller_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("ООО "), F.when(k % 4 == 0, "АГРОТОРГ").when(k % 4 == 1, "Тандер").when(k % 4 == 2, "Тандер Аптека").otherwise("Ромашка"))
    return table(spark, sf_dir, "supplier").select(k, receipts.seller(name, [("агроторг", "a"), ("тандер", "b")], {"b": ["аптека"]}).alias("chain"))


@query(
    """SELECT l_orderkey AS basket_id, l_partkey AS sku, CASE WHEN b.price IS NULL OR b.gone THEN 'gone' WHEN abs(b.price - a.price) > 0.004 THEN 'changed' ELSE 'same' END AS change
    FROM (SELECT l_orderkey, l_partkey, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL) a
    LEFT JOIN (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS price, bool_and(l_returnflag = 'R') AS gone FROM lineitem WHERE l_partkey % 4 > 0 GROUP BY ALL) b USING (l_orderkey, l_partkey)"""
)
def plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumns({"basket_id": F.col("l_orderkey"), "sku": F.col("l_partkey")})
    old = li.groupBy("basket_id", "sku").agg(F.min("l_extendedprice").alias("price"))
    new = li.filter("l_partkey % 4 > 0").groupBy("basket_id", "sku").agg(F.max("l_extendedprice").alias("price"), (~F.bool_and(F.col("l_returnflag") == "R")).alias("in_stock"))
    return carts.verify(old, new).select("basket_id", "sku", "change")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'сыр' WHEN 1 THEN 'молоко' WHEN 2 THEN NULL ELSE 'чай' END AS kind FROM part"""
)
def product_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat_ws(" ", F.when(k % 4 == 0, "Сыр Страчателла").when(k % 4 == 1, "Отборное МОЛОКО").when(k % 4 == 2, "Нечто").otherwise("набор чай и кофе"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", conflicts.product_type(name).alias("kind"))


@query(
    """SELECT shopper, months FROM (SELECT o_custkey AS shopper, CAST(date_diff('month', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1 AS INT) AS months FROM orders GROUP BY 1)"""
)
def months_of_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("shopper")).agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return o.select("shopper", prices.months_inclusive(F.col("a"), F.col("b")).alias("months"))


@query(
    """WITH a AS (SELECT l_suppkey % 5 AS store, l_partkey AS product_id, min(l_extendedprice) AS price FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY ALL),
    h AS (SELECT l_suppkey % 5 AS store, l_partkey AS product_id, arg_max(l_extendedprice, (l_shipdate, l_extendedprice)) AS r FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
    SELECT store, product_id, coalesce(price, r) AS price, CASE WHEN price IS NULL THEN 'receipt' ELSE 'list' END AS source FROM a FULL JOIN h USING (store, product_id)"""
)
def price_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumns({"store": F.col("l_suppkey") % 5, "product_id": F.col("l_partkey")})
    listed = li.filter("l_partkey % 2 = 0").groupBy("store", "product_id").agg(F.min("l_extendedprice").alias("price"))
    hist = li.filter("l_linestatus = 'F'").select("store", "product_id", F.col("l_extendedprice").alias("unit_price"), F.col("l_shipdate").alias("day"), F.col("l_extendedprice").alias("id"))
    return carts.price_sources(listed, hist)


@query(
    """WITH r AS (SELECT l_suppkey AS point, l_returnflag AS chain, min(l_orderkey) AS position FROM lineitem GROUP BY ALL)
    SELECT chain, point, row_number() OVER (PARTITION BY chain ORDER BY position, point) AS rank FROM r QUALIFY rank <= 5"""
)
def points_of_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chain"), F.col("l_suppkey").alias("point"), F.col("l_orderkey").alias("position"))
    return market.addresses_to_points(rows, 5).select("chain", "point", "rank")


@query(
    """SELECT chain, sku, CAST(sum(n) AS BIGINT) AS times FROM (SELECT event_type AS chain, user_id AS sku, 2 AS n FROM (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 3 = 0)
    UNION ALL SELECT event_type, user_id, 1 FROM events WHERE event_id % 5 = 0) WHERE (chain, sku) NOT IN (SELECT event_type, user_id FROM events WHERE event_id % 50 = 1) GROUP BY ALL"""
)
def miss_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("chain"), F.col("user_id").alias("sku"))
    now = F.lit("2024-02-01").cast("timestamp")
    old = e.filter("event_id % 3 = 0").select("chain", "sku").distinct().withColumns({"times": F.lit(2), "last_miss": now})
    return history.note_misses(old, e.filter("event_id % 5 = 0"), e.filter("event_id % 50 = 1"), now).select("chain", "sku", "times")
