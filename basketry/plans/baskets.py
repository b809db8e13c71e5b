"""Queries on totals, offers and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.prices import offer_discount, whole_pieces
from basketry.operators import optimise
from basketry.operators.offers import best_offer as best_offers
from basketry.registry import query, table
from basketry.session import dealt


@query(
    """SELECT o_orderkey AS basket_id, CASE WHEN o_totalprice >= 1000 THEN round(least(o_totalprice * (1 + o_custkey % 10) / 100.0, greatest(500.0 - o_orderkey % 600, 0)), 2) ELSE 0 END AS discount FROM orders"""
)
def offer_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d = offer_discount(F.col("o_totalprice"), 1 + F.col("o_custkey") % 10, F.lit(500.0), F.lit(1000.0), (F.col("o_orderkey") % 600).cast("double"))
    return o.select(F.col("o_orderkey").alias("basket_id"), d.alias("discount"))


LINES_SQL = """
    ln AS (SELECT l_orderkey AS basket_id, l_partkey AS product_id, l_suppkey % 4 AS store, floor(min(l_extendedprice) + 0.5) / 100 AS value FROM lineitem GROUP BY ALL),
    st AS (SELECT s_suppkey AS store, 90.0 + 10 * s_suppkey AS fee, 600.0 + 100 * s_suppkey AS free_from, 100.0 * s_suppkey AS min_order FROM (SELECT DISTINCT s_suppkey % 4 AS s_suppkey FROM supplier))"""


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a product and store; a basket's lines lie together, so what follows by baskets moves nothing."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % 4).alias("store"), "l_extendedprice")
    g = dealt(rows, li.count(), "basket_id").groupBy("basket_id", "product_id", "store")
    return g.agg((F.floor(F.min("l_extendedprice") + 0.5) / 100).alias("value")).withColumns({"in_stock": F.lit(True), "adjust": F.lit(0.0)})


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four stores that all suppliers are dealt to."""
    s = table(spark, sf_dir, "supplier")
    s = s.select((F.col("s_suppkey") % 4).alias("store")).distinct()
    k = F.col("store")
    return s.withColumns({"fee": 90.0 + 10 * k, "free_from": 600.0 + 100 * k, "min_order": 100.0 * k, "penalty": 5.0 * k, "percent": F.when(k == 2, 5.0), "cap": F.lit(100.0), "min_check": F.lit(500.0), "cap_used": F.lit(0.0)})


@query(
    f"""WITH {LINES_SQL}, n AS (SELECT basket_id, count(DISTINCT product_id) AS n FROM ln GROUP BY 1),
    t AS (SELECT basket_id, store, round(sum(value), 2) AS subtotal, count(*) AS have FROM ln GROUP BY ALL)
    SELECT basket_id, store, subtotal, CASE WHEN subtotal >= free_from THEN 0 ELSE fee END AS delivery, round(subtotal + CASE WHEN subtotal >= free_from THEN 0 ELSE fee END, 2) AS total,
           n - have AS missing, subtotal < min_order AS below_minimum FROM t JOIN n USING (basket_id) JOIN st USING (store)"""
)
def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimise.store_totals(basket_lines(spark, sf_dir), shops(spark, sf_dir))


@query(
    """WITH o AS (SELECT o_orderkey AS basket_id, o_custkey % 4 AS store, round(o_totalprice, 2) AS total FROM orders),
    f AS (SELECT s_suppkey AS offer_id, s_suppkey % 4 AS store, 1.0 + s_suppkey % 7 AS percent, 50.0 * (s_suppkey % 6 + 1) AS cap, 1000.0 * (s_suppkey % 3) AS min_check FROM supplier),
    d AS (SELECT o.*, offer_id, percent, CASE WHEN total >= min_check THEN round(least(total * percent / 100, cap), 2) ELSE 0 END AS discount FROM o LEFT JOIN f USING (store))
    SELECT basket_id, store, total, coalesce(discount, 0) AS discount, CASE WHEN discount > 0 THEN offer_id END AS offer_id FROM d
    QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY discount DESC NULLS LAST, percent DESC, offer_id) = 1"""
)
def best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("basket_id"), (F.col("o_custkey") % 4).alias("store"), F.round("o_totalprice", 2).alias("total"))
    k = F.col("s_suppkey")
    offers = table(spark, sf_dir, "supplier").select(k.alias("offer_id"), (k % 4).alias("store"), (1.0 + k % 7).alias("percent"), (50.0 * (k % 6 + 1)).alias("cap"), (1000.0 * (k % 3)).alias("min_check"), F.lit(0.0).alias("cap_used"))
    return best_offers(totals, offers)


SPLIT_SQL = f"""WITH {LINES_SQL},
    pair AS (SELECT a.store AS x, b.store AS y FROM st a JOIN st b ON a.store < b.store),
    n AS (SELECT basket_id, count(DISTINCT product_id) AS n FROM ln GROUP BY 1),
    p AS (SELECT basket_id, x, y, product_id, max(CASE WHEN store = x THEN round(value * 100) END) AS a, max(CASE WHEN store = y THEN round(value * 100) END) AS b,
                 row_number() OVER (PARTITION BY basket_id, x, y ORDER BY product_id) - 1 AS i, count(*) OVER (PARTITION BY basket_id, x, y) AS k FROM ln JOIN pair ON store IN (x, y) GROUP BY 1, 2, 3, 4),
    m AS (SELECT basket_id, x, y, k, mask, sum(CASE WHEN (mask >> i) & 1 = 0 THEN a ELSE 0 END) AS s1, sum(CASE WHEN (mask >> i) & 1 = 1 THEN b ELSE 0 END) AS s2,
                 bool_and(CASE WHEN (mask >> i) & 1 = 0 THEN a IS NOT NULL ELSE b IS NOT NULL END) AS ok
          FROM (SELECT *, unnest(range(0, 1 << k)) AS mask FROM p) GROUP BY ALL),
    c AS (SELECT basket_id, n - k AS missing,
            CASE WHEN s1 > 0 THEN s1 + CASE WHEN s1 >= 60000 + 10000 * x THEN 0 ELSE 9000 + 1000 * x END + CASE WHEN s1 < 10000 * x THEN 1000000000 ELSE 0 END + 500 * x
                 - CASE WHEN x = 2 AND s1 >= 50000 THEN round_even(least(s1 * 5 / 100, 10000), 0) ELSE 0 END ELSE 0 END
          + CASE WHEN s2 > 0 THEN s2 + CASE WHEN s2 >= 60000 + 10000 * y THEN 0 ELSE 9000 + 1000 * y END + CASE WHEN s2 < 10000 * y THEN 1000000000 ELSE 0 END + 500 * y
                 - CASE WHEN y = 2 AND s2 >= 50000 THEN round_even(least(s2 * 5 / 100, 10000), 0) ELSE 0 END ELSE 0 END AS cost FROM m JOIN n USING (basket_id) WHERE ok)
    SELECT basket_id, missing, CAST(min(cost) AS BIGINT) AS cost FROM c GROUP BY basket_id, missing QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY missing) = 1"""


@query(SPLIT_SQL)
def split_two_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing lines and least cost of every basket over each of the four stores and each pair of them; the SQL tries every mask."""
    best = optimise.split_baskets(basket_lines(spark, sf_dir), shops(spark, sf_dir), most_stores=2, keep=1)
    return best.select("basket_id", "missing", "cost")


@query("SELECT l_orderkey AS basket_id, l_partkey AS product_id, CAST(greatest(1, floor(max(l_quantity) / 3 + 0.5)) AS BIGINT) AS qty FROM lineitem GROUP BY ALL")
def whole_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id")).agg(whole_pieces(F.max("l_quantity") / 3).cast("long").alias("qty"))


@query(
    """SELECT o_orderkey AS basket_id, round(bonus, 2) AS bonus_used, round(rest - bonus + 29, 2) AS payable FROM
    (SELECT *, least(200.0, rest * 0.3) AS bonus FROM (SELECT o_orderkey, greatest(0, o_totalprice - 150.0) AS rest FROM orders))"""
)
def promo_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_totalprice").alias("subtotal"))
    parts = o.withColumns({"promo": F.lit(150.0), "bonus": F.lit(200.0), "bonus_pct": F.lit(30.0), "percent": F.lit(0.0), "cap": F.lit(None).cast("double"), "min_check": F.lit(0.0), "cap_used": F.lit(0.0), "service_fee": F.lit(29.0)})
    return optimise.promo_stages(parts).select("basket_id", "bonus_used", "payable")
