"""Queries on line prices, coupons, statuses and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import prices as p
from basketry.operators import carts, compare, device, health, history, link, market, optimise, search
from basketry.plans.baskets import LINES_SQL, basket_lines
from basketry.registry import query, table

LP_SQL = """q AS (SELECT p_partkey AS k, p_retailprice AS price, CASE WHEN p_partkey % 3 = 0 THEN 'kg' WHEN p_partkey % 3 = 1 THEN 'pcs' END AS unit, CASE WHEN p_partkey % 4 > 0 THEN p_size * 50.0 END AS pack,
        CAST(p_partkey % 7 AS DOUBLE) / 2 + 0.25 AS qty, p_partkey % 2 = 0 AS weighed, CASE WHEN p_partkey % 5 > 0 THEN 400.0 END AS ref, p_partkey % 9 = 0 AS portions, p_partkey % 3 = 0 AS loose FROM part),
    f AS (SELECT *, coalesce(pack, 0) > 0 AND coalesce(unit, '') <> 'kg' AS packed FROM q), g AS (SELECT *, NOT packed AND loose AS by_weight FROM f),
    h AS (SELECT *, CASE WHEN by_weight AND portions AND pack > 0 THEN pack END AS portion, greatest(1, ceil(qty - 1e-9)) AS n, greatest(1, ceil(qty * 1000 / pack - 1e-9)) AS packs FROM g),
    v AS (SELECT *, CASE WHEN weighed THEN CASE WHEN packed THEN packs * price WHEN portion IS NOT NULL THEN packs * price * portion / 1000 WHEN by_weight THEN price * qty WHEN unit = 'pcs' THEN NULL ELSE price * qty END
                         WHEN by_weight THEN price * coalesce(portion, ref) / 1000 * n ELSE price * n END AS value FROM h)"""


@query(
    f"""WITH {LP_SQL} SELECT k AS product, floor(value * 100 + 0.5) AS kopecks, CASE WHEN value IS NULL THEN NULL WHEN NOT weighed AND NOT by_weight AND ref > 0 AND pack > 0 AND abs(pack - ref) / ref > 0.03 THEN true ELSE false END AS adjusted FROM v"""
)
def line_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision table of a line's price over every combination of unit, pack, weighing and portions."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    none = F.lit(None).cast("double")
    pack, ref = F.when(k % 4 > 0, F.col("p_size") * 50.0), F.when(k % 5 > 0, 400.0)
    price = F.col("p_retailprice")
    lp = p.line_price(price, none, F.when(k % 3 == 0, "kg").when(k % 3 == 1, "pcs"), pack, (k % 7).cast("double") / 2 + 0.25, k % 2 == 0, ref, k % 9 == 0, k % 3 == 0)
    out = part.select(k.alias("product"), lp.alias("l"))
    return out.select("product", F.floor(F.col("l.value") * 100 + 0.5).cast("double").alias("kopecks"), (F.col("l.adjust") != 0).alias("adjusted"))


@query(
    """WITH pr AS (SELECT p_partkey AS sku, round(p_retailprice, 2) AS price FROM part), c AS (SELECT s_suppkey AS id, s_suppkey * 3 % 200 AS sku, CASE s_suppkey % 3 WHEN 0 THEN 500.0 END AS cp, CASE s_suppkey % 3 WHEN 1 THEN 20.0 END AS pct, CASE s_suppkey % 3 WHEN 2 THEN 75.0 END AS off FROM supplier),
    a AS (SELECT pr.sku, price, id, floor(greatest(0, least(price, coalesce(cp, price * (1 - pct / 100), price - off, price))) * 100 + 0.5) AS k FROM pr LEFT JOIN c USING (sku))
    SELECT sku, min(k) AS kopecks FROM a GROUP BY sku"""
)
def coupon_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.round("p_retailprice", 2).alias("price"))
    coupons = table(spark, sf_dir, "supplier").select(k.alias("coupon_id"), (k * 3 % 200).alias("sku"), F.when(k % 3 == 0, 500.0).alias("coupon_price"), F.when(k % 3 == 1, 20.0).alias("percent"), F.when(k % 3 == 2, 75.0).alias("off"))
    out = carts.best_coupons(prices.withColumn("store", F.lit("a")), coupons.withColumn("store", F.lit("a")))
    return out.select("sku", F.floor(F.col("my_price") * 100 + 0.5).cast("double").alias("kopecks"))


@query(
    """WITH h AS (SELECT l_partkey AS product, max((l_quantity * (l_linenumber % 3) / 2 <> floor(l_quantity * (l_linenumber % 3) / 2))::INT) = 1 AS frac FROM lineitem WHERE l_partkey % 4 = 0 GROUP BY 1),
    c AS (SELECT l_partkey AS product, 2 * count_if((l_partkey + l_suppkey) % 2 = 0) > count(*) AS votes FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1)
    SELECT p_partkey AS product, CASE WHEN p_partkey % 5 = 0 THEN true WHEN p_partkey % 5 = 1 THEN false WHEN frac THEN true WHEN frac IS NOT NULL THEN false WHEN votes IS NOT NULL THEN votes ELSE true END AS weighed
    FROM part LEFT JOIN h ON h.product = p_partkey LEFT JOIN c ON c.product = p_partkey"""
)
def weighed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    products = table(spark, sf_dir, "part").select(k.alias("product_id"), F.when(k % 5 == 0, "Груша весовая").when(k % 5 == 1, "Груша 500 г").otherwise("Груша").alias("name"))
    li = table(spark, sf_dir, "lineitem")
    # products that nobody bought go by how chains sell them, and some no chain sells
    hist = li.filter("l_partkey % 4 = 0").select(F.col("l_partkey").alias("product_id"), (F.col("l_quantity") * (F.col("l_linenumber") % 3) / 2).alias("qty"))
    sold = li.filter("l_partkey % 3 > 0").select(F.col("l_partkey").alias("product_id"), F.when((F.col("l_partkey") + F.col("l_suppkey")) % 2 == 0, "kg").otherwise("pcs").alias("unit"))
    return carts.weighed_products(products, hist, sold).select(F.col("product_id").alias("product"), "weighed")


@query(
    f"""WITH {LINES_SQL} SELECT basket_id, product_id, coalesce(max(CASE WHEN product_id % 5 = 0 THEN value END), max(CASE WHEN store = 1 THEN value END), CASE WHEN count(*) < 3 THEN min(value) ELSE
        coalesce(min(value) FILTER (value BETWEEN 0.2 * m AND 5 * m), min(value)) END) AS baseline
    FROM (SELECT *, list_sort(list(value) OVER w)[len(list(value) OVER w) // 2 + 1] AS m FROM ln WINDOW w AS (PARTITION BY basket_id, product_id)) GROUP BY ALL"""
)
def line_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last receipt's price (of every fifth product), else the base store's (1), else the sane minimum."""
    lines = basket_lines(spark, sf_dir).withColumns({"receipt_price": F.when(F.col("product_id") % 5 == 0, F.col("value")), "is_base": F.col("store") == 1})
    return optimise.baseline(lines)


@query(
    f"""WITH {LINES_SQL}, d AS (SELECT *, 10.0 AS discount, row_number() OVER (PARTITION BY basket_id, store ORDER BY product_id) AS pos, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY basket_id, store) AS whole FROM ln)
    , s AS (SELECT *, round_even(1000 * CAST(round(value * 100) AS BIGINT) / whole, 0) AS share FROM d)
    SELECT basket_id, store, product_id, CAST(share + CASE WHEN pos = max(pos) OVER g THEN 1000 - sum(share) OVER g ELSE 0 END AS BIGINT) AS kopecks FROM s WINDOW g AS (PARTITION BY basket_id, store)"""
)
def shared_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's part of a discount of ten that its store gives; the last line has what rounding leaves."""
    from pyspark.sql.window import Window

    lines = basket_lines(spark, sf_dir).withColumns({"discount": F.lit(10.0), "position": F.row_number().over(Window.partitionBy("basket_id", "store").orderBy("product_id"))})
    return optimise.share_discount(lines).select("basket_id", "store", "product_id", F.round(F.col("share") * 100).cast("long").alias("kopecks"))


@query(
    """SELECT o_orderkey AS basket_id, o_orderkey % 4 AS store, CASE WHEN fit THEN 'network' ELSE 'shelf' END AS source, CASE WHEN fit THEN round(o_totalprice, 2) - 5 ELSE 100.0 END AS total
    FROM (SELECT *, o_custkey % 2 = 0 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderkey % 3 > 0 AS fit FROM orders)"""
)
def network_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain's own total replaces ours where its quote is complete, fresh and of this very basket."""
    o = table(spark, sf_dir, "orders").withColumns({"basket_id": F.col("o_orderkey"), "store": F.col("o_orderkey") % 4})
    places = o.select("basket_id", "store", F.lit("s").alias("stamp"), F.lit(100.0).alias("total"), F.lit(5.0).alias("discount"))
    quotes = o.select("basket_id", "store", F.when(F.col("o_orderkey") % 3 > 0, "s").otherwise("old").alias("stamp"), F.round("o_totalprice", 2).alias("total"), (F.col("o_custkey") % 2 == 0).alias("complete"), "o_orderdate")
    return optimise.network_overlay(places, quotes, F.col("o_orderdate").cast("timestamp") >= F.lit("1996-01-01").cast("timestamp")).select("basket_id", "store", "source", "total")


@query(
    """WITH l AS (SELECT DISTINCT l_partkey AS product_id, l_partkey % 50 AS item_id FROM lineitem), s AS (SELECT p_partkey AS sku, p_partkey % 50 AS item_id, p_brand AS chain, p_size * 1.0 AS g, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS price, p_partkey % 5 > 0 AS stock FROM part)
    SELECT product_id, chain, sku FROM l JOIN s USING (item_id) QUALIFY row_number() OVER (PARTITION BY product_id, chain ORDER BY price IS NULL, NOT stock, abs(25 - g), sku) = 1"""
)
def linked_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SKU that a linked product gets in each chain."""
    k = F.col("p_partkey")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), (F.col("l_partkey") % 50).alias("item_id")).distinct().withColumns({"method": F.lit("words"), "weight_g": F.lit(25.0)})
    skus = table(spark, sf_dir, "part").select(k.alias("sku"), (k % 50).alias("item_id"), F.col("p_brand").alias("chain"), (F.col("p_size") * 1.0).alias("sku_weight_g"), F.when(k % 2 == 0, F.col("p_retailprice")).alias("price"), (k % 5 > 0).alias("in_stock"))
    return link.materialize(links, skus).select("product_id", "chain", "sku")


@query(
    """SELECT p_partkey AS sku, p_brand AS chain, CASE WHEN NOT (p_brand = 'Brand#11' AND mine IS NULL) THEN coalesce(mine, p_retailprice) END AS my_price
    FROM part LEFT JOIN (SELECT p_partkey AS k, p_retailprice - 1 AS mine FROM part WHERE p_partkey % 3 = 0) ON k = p_partkey"""
)
def my_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain prices by point: without my point's price it has none for me."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_brand").alias("chain"), F.col("p_retailprice").alias("price"), F.lit(True).alias("in_stock"))
    mine = part.filter("sku % 3 = 0").withColumn("price", F.col("price") - 1)
    return market.price_for_me(part, mine, ["chain", "sku"], ["Brand#11"]).select("sku", "chain", "my_price")


@query(
    """SELECT p_partkey AS sku, CASE WHEN hit AND act THEN coalesce(st, true) ELSE true END AS in_stock, CASE WHEN hit AND act AND named IS NOT NULL THEN named ELSE p_retailprice END AS price FROM
    (SELECT *, p_partkey % 2 = 0 AS hit, p_partkey % 3 > 0 AS act, CASE WHEN p_partkey % 4 = 0 THEN false END AS st, CASE WHEN p_partkey % 6 = 2 THEN p_retailprice * 2 END AS named FROM part)"""
)
def device_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock and price that devices saw reach active rows only, and only where they are known."""
    k, now = F.col("p_partkey"), F.lit("2024-05-01").cast("timestamp")
    cat = table(spark, sf_dir, "part").select(F.lit("m").alias("chain"), k.alias("sku"), F.lit(True).alias("in_stock"), F.col("p_retailprice").alias("price"), now.alias("price_seen"), (k % 3 > 0).alias("active"), now.alias("last_seen"))
    seen = table(spark, sf_dir, "part").filter(k % 2 == 0).select(F.lit("m").alias("chain"), k.alias("sku"), F.when(k % 4 == 0, False).alias("stock"), F.when(k % 6 == 2, F.col("p_retailprice") * 2).alias("named_price"), now.alias("at"))
    return device.set_values(cat, seen, now).select("sku", "in_stock", "price")


@query(
    """SELECT event_type AS chain, count(*) AS runs, count_if(status = 'failed') AS failed FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15 18:00:00' THEN 'failed' WHEN event_id % 2 = 0 THEN 'running' ELSE 'ok' END AS status FROM events) GROUP BY 1"""
)
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), F.when(F.col("event_id") % 2 == 0, "running").otherwise("ok").alias("status"), F.col("ts").cast("timestamp").alias("started_at"))
    runs = history.close_stale_runs(e, F.lit("2024-01-16").cast("timestamp"))
    return runs.groupBy("chain").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("SELECT DISTINCT event_type AS chain FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00'")
def fresh_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), F.lit("ok").alias("status"), F.col("ts").cast("timestamp").alias("finished_at"))
    return health.fresh_chains(e, F.lit("2024-01-30").cast("timestamp"))


@query("SELECT event_type AS chain, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type NOT IN ('view', 'click') GROUP BY 1")
def phone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of chains that no run of ours completed since: two event types have such a run."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), F.col("ts").cast("timestamp").alias("first_seen"))
    since = F.lit("2024-01-20").cast("timestamp")
    runs = spark.createDataFrame([("view", "ok"), ("click", "ok")], "chain string, status string").withColumn("finished_at", since)
    return health.phone_rows(e, runs, since).withColumnRenamed("count", "n")


@query("SELECT p_partkey AS item_id FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'brand#1') AND contains(lower(p_name || ' ' || p_brand), 'a')")
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_brand")
    return search.token_filter(items, "brand#1 a", ["p_name", "p_brand"], 10_000_000).select("item_id")


@query(
    """SELECT p_partkey AS product_id, s AS store, CASE WHEN m IS NULL THEN 'not mapped' WHEN price IS NULL THEN 'no fresh price' WHEN NOT stock THEN 'out of stock' END AS note FROM
    (SELECT p_partkey, s, CASE WHEN (p_partkey + s) % 3 > 0 THEN 1 END AS m, CASE WHEN (p_partkey + s) % 3 > 0 AND (p_partkey + s) % 4 > 0 THEN 100.0 END AS price, p_partkey % 5 > 0 AS stock FROM part, (SELECT DISTINCT s_suppkey % 4 AS s FROM supplier))"""
)
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product in four stores: mapped or not, priced or not, in stock or not."""
    k = F.col("product_id")
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"))
    stores, s = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    stores = stores.select((s % 4).alias("store")).distinct()
    every = market.in_each(products, stores, "store").withColumn("n", k + F.col("store"))
    maps = every.filter("n % 3 > 0").select("product_id", "store", k.alias("sku"), F.lit("pcs").alias("unit"), F.lit(500.0).alias("weight_g"))
    prices = every.filter("n % 3 > 0 and n % 4 > 0").select("store", k.alias("sku"), F.lit(100.0).alias("price"), (k % 5 > 0).alias("in_stock"))
    return compare.compare_products(products, stores, maps, prices).select("product_id", "store", "note")


@query(
    """SELECT o_orderkey AS basket_id, o_custkey % 7 < o_custkey % 5 OR (o_custkey % 7 = o_custkey % 5 AND o_totalprice - (o_totalprice * 0.9 + 100) >= 250.0000001) AS split FROM orders"""
)
def split_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split is advised if one shop lacks more, or as much and the split saves enough; never if the split itself lacks more."""
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    advice = optimise.split_advised(F.col("o_totalprice") * 0.9 + 100, c % 7, F.col("o_totalprice"), c % 5, 250.0000001)
    return o.select(F.col("o_orderkey").alias("basket_id"), advice.alias("split"))


@query(
    """WITH r AS (SELECT min(p_partkey) AS id, p_name || ' ' || p_brand || ' ' || p_type AS name FROM part GROUP BY name), t AS (SELECT id, unnest(list_distinct(string_split(name, ' '))) AS w FROM r),
    a AS (SELECT p_partkey AS wanted_id, list_distinct(string_split(p_name || ' ' || p_brand || ' ' || CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE 'any' END || ' size' || p_size, ' ')) AS ws FROM part),
    h AS (SELECT wanted_id, id, count(*) AS hits, any_value(n) AS n FROM (SELECT wanted_id, len(ws) AS n, unnest(ws) AS w FROM a) JOIN t USING (w) GROUP BY wanted_id, id)
    SELECT wanted_id, min(id) AS id FROM (SELECT * FROM h QUALIFY hits = max(hits) OVER (PARTITION BY wanted_id)) GROUP BY wanted_id HAVING count(*) = 1 AND max(hits) >= 0.6 * max(n)"""
)
def linked_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose words, a size that no name has among them, point to one line of goods; a third of them do not name the kind."""
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    lines = p.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("id")).select("id", F.split("name", " ").alias("fwords"))
    kind = F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise("any")
    wanted = p.select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_brand", kind, F.concat(F.lit("size"), F.col("p_size").cast("string"))), " ").alias("fwords"))
    return link.unique_by_words(wanted, lines)
