"""Queries on receipts and habits: customers are shoppers, orders receipts, line items purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import habits, receipts, workspace
from basketry.registry import query, table

TODAY = "1998-12-31"
HISTORY_SQL = """h AS (SELECT o_custkey AS shopper, l_partkey AS product, o_orderdate::DATE AS day, l_quantity AS qty, o_orderkey AS key, l_extendedprice AS total
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
HABITS_SQL = (
    HISTORY_SQL
    + f""", d AS (SELECT shopper, product, day, sum(qty) AS qty FROM h GROUP BY ALL),
    hb AS (SELECT shopper, product, count(*) AS times, median(qty) AS qty, CASE WHEN count(*) > 1 THEN round(date_diff('day', min(day), max(day)) / (count(*) - 1), 1) END AS cycle,
           date_diff('day', max(day), DATE '{TODAY}') AS since FROM d GROUP BY ALL)"""
)


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = o.select("o_orderkey", "o_custkey", "o_orderdate").join(li.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("o_custkey").alias("shopper"), F.col("l_partkey").alias("product"), F.col("o_orderdate").cast("date").alias("day"), F.col("l_quantity").alias("qty"), F.col("o_orderkey").alias("key"), F.col("l_extendedprice").alias("total"))


@query(f"WITH {HISTORY_SQL} SELECT shopper, product, sum(qty) AS qty FROM h JOIN (SELECT shopper, max(day) AS day FROM h GROUP BY 1) USING (shopper, day) GROUP BY ALL")
def last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.last_purchase(purchases(spark, sf_dir))


@query(
    f"""WITH {HISTORY_SQL}, m AS (SELECT shopper, count(DISTINCT strftime(day, '%Y-%m')) AS months FROM h GROUP BY 1)
    SELECT shopper, product, round(sum(qty) / any_value(months), 3) AS qty FROM h JOIN m USING (shopper) GROUP BY ALL"""
)
def month_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.month_average(purchases(spark, sf_dir))


@query(f"WITH {HABITS_SQL} SELECT shopper, product, times, qty, cycle, since FROM hb")
def shopper_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.habits(purchases(spark, sf_dir), F.lit(TODAY).cast("date")).select("shopper", "product", "times", "qty", "cycle", "since")


@query(f"WITH {HABITS_SQL} SELECT shopper, product, cycle, since FROM hb WHERE cycle IS NOT NULL AND since >= cycle")
def due_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.due(habits.habits(purchases(spark, sf_dir), F.lit(TODAY).cast("date"))).select("shopper", "product", "cycle", "since")


@query(f"WITH {HABITS_SQL} SELECT shopper, product, qty FROM hb WHERE times >= 2")
def usual_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.usual(habits.habits(purchases(spark, sf_dir), F.lit(TODAY).cast("date")), 2).select("shopper", "product", "qty")


@query(
    f"""WITH {HISTORY_SQL}, r AS (SELECT shopper, product, count(DISTINCT day) AS days FROM h GROUP BY ALL HAVING count(DISTINCT day) >= 2)
    SELECT * FROM r WHERE (shopper, product) NOT IN (SELECT shopper, product FROM h WHERE key % 2 = 0)"""
)
def missing_regulars(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = purchases(spark, sf_dir)
    return habits.missing_regulars(habits.regular(h, 2), h.filter("key % 2 = 0").select("shopper", "product").distinct())


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS receipts, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def receipts_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.count(F.lit(1)).alias("receipts"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double"), 2).alias("total"))


@query(
    """SELECT coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END, '(none)') AS store, count(DISTINCT o_orderkey) AS receipts, count(*) AS rows,
    min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""
)
def loaded_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("store"))
    h = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    h = h.select("store", F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("day"), F.col("l_extendedprice").cast("decimal(18,4)").alias("total"))
    return receipts.loaded(h).withColumn("total", F.col("total").cast("double"))


@query("SELECT l_returnflag || l_linestatus AS raw_name, max(l_shipdate)::DATE AS last_day, count(*) AS times FROM lineitem GROUP BY 1 ORDER BY last_day DESC, raw_name LIMIT 4")
def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("raw_name"), F.col("l_shipdate").cast("date").alias("day"))
    return receipts.raw_names(li, 4)


@query(
    """SELECT o_orderkey AS key, CASE WHEN max(r) = 4 THEN 'imported' WHEN max(r) = 3 THEN 'other_store' WHEN max(r) = 2 THEN 'unavailable' ELSE 'seen' END AS state
    FROM (SELECT o_orderkey, 1 AS r FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_custkey % 5 = 0
          UNION ALL SELECT o_orderkey, 4 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"""
)
def receipt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = lambda df, s: df.select(F.col("o_orderkey").alias("key"), F.lit(s).alias("state"), F.col("o_orderdate").alias("at"))
    every = state(o, "seen").union(state(o.filter("o_custkey % 3 = 0"), "unavailable")).union(state(o.filter("o_custkey % 5 = 0"), "other_store")).union(state(o.filter("o_orderstatus = 'F'"), "imported"))
    return receipts.ledger(every).select("key", "state")


@query("SELECT o_custkey AS shopper, max(o_orderdate)::DATE AS last_day, count(*) AS orders, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def orders_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("shopper")).agg(F.max("o_orderdate").cast("date").alias("last_day"), F.count(F.lit(1)).alias("orders"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 1000")
def shopper_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left outer join of shoppers and their receipts."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 1000")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query(
    """SELECT l_partkey AS item_id, l_returnflag AS chain, l_linestatus AS variant, min(l_shipdate)::DATE AS first_seen, max(l_shipdate)::DATE AS last_seen, count(*) AS hits FROM lineitem GROUP BY 1, 2, 3"""
)
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return receipts.name_variants(li.select(F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("chain"), F.col("l_linestatus").alias("variant"), F.col("l_shipdate").cast("date").alias("seen")))


SYNC_SQL = """b AS (SELECT o_custkey, o_orderkey + 1 AS o_orderkey, max(o_orderkey + 1) OVER (PARTITION BY o_custkey) AS top FROM orders),
    a AS (SELECT *, CASE WHEN o_orderkey % 3 = 1 THEN greatest(top_kept, top) + row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 = 1 ORDER BY o_orderkey) ELSE o_orderkey END AS basket_id
          FROM (SELECT *, coalesce(max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey), 0) AS top_kept FROM b) WHERE o_orderkey % 3 < 2)"""


def synced(spark: SparkSession, sf_dir: str) -> workspace.State:
    """Each shopper's orders are baskets of a workspace; a document of each keeps every third of them under its id, sends the next third
    under made-up ids with products of the catalogue (negative numbers) and
    leaves out the rest. Keys count from 1 here, as an id of zero stands for none."""
    o, li, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    lines = li.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("double").alias("qty"))
    own = o.select(F.col("o_custkey").cast("string").alias("workspace"), (F.col("o_orderkey").cast("long") + 1).alias("basket_id"))
    state = workspace.empty_state(spark)
    state["baskets"] = own.select("workspace", "basket_id", F.lit("old").alias("name"), F.lit("1998-01-01").alias("created_at"), F.lit("manual").alias("source"))
    third = F.col("basket_id") % 3
    sent = own.filter(third < 2).withColumn("id", F.when(third == 1, -F.col("basket_id")).otherwise(F.col("basket_id")))
    rows = lines.select((F.col("l_orderkey").cast("long") + 1).alias("basket_id"), (-1 - F.col("l_partkey").cast("long")).alias("product_id"), "qty")
    per = sent.join(rows, "basket_id", "left").groupBy("workspace", "basket_id", "id").agg(F.array_sort(F.collect_list(F.when(F.col("product_id").isNotNull(), F.struct("product_id", "qty")))).alias("rows"))
    one = F.array_sort(F.collect_list(F.struct("basket_id", "id", "rows")))
    docs = per.groupBy("workspace").agg(one.alias("b"))
    ids = F.array_distinct(F.flatten(F.transform("b", lambda x: F.transform(x["rows"], lambda r: r["product_id"]))))
    body = F.struct(F.transform(ids, lambda i: F.struct(i.alias("id"))).alias("products"), F.transform("b", lambda x: F.struct(x["id"].alias("id"), F.lit("new").alias("name"))).alias("baskets"),
                    F.map_from_entries(F.transform("b", lambda x: F.struct(x["id"].cast("string").alias("k"), x["rows"].alias("v")))).alias("basketItems"))
    docs = docs.select("workspace", F.lit(1).alias("version"), F.to_json(body).alias("document"))
    catalog = c.select((F.col("p_partkey").cast("long") + 1).alias("item_id"), F.concat_ws(" ", F.lit("part"), "p_partkey").alias("name"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("double").alias("weight_g"), F.lit("pcs").alias("unit"), F.lit(None).cast("string").alias("category"))
    return workspace.apply_documents(state, docs, catalog, spark.range(0).toDF("store_id"), spark.createDataFrame([], "chain string"), "1998-12-31")


@query(
    f"""WITH {SYNC_SQL}, l AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)
    SELECT CAST(o_custkey AS VARCHAR) AS workspace, basket_id, 'part ' || l_partkey AS product, CAST(qty AS DOUBLE) AS qty FROM a JOIN l ON l_orderkey + 1 = o_orderkey JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), basket_id, NULL, NULL FROM a
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), o_orderkey + 1, NULL, NULL FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM a)"""
)
def synced_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines by the names of their products, and a row without product for each basket."""
    s = synced(spark, sf_dir)
    lines = s["items"].join(s["products"].select("workspace", "product_id", F.col("name").alias("product")).hint("merge"), ["workspace", "product_id"])
    return lines.select("workspace", "basket_id", "product", "qty").unionByName(s["baskets"].select("workspace", "basket_id"), allowMissingColumns=True)
