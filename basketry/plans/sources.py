"""Queries that write the driver's rows the way sources do and read them again through the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import prices as p
from basketry.functions import text as t
from basketry.operators import device, receipts
from basketry.registry import query, table
from basketry.sources import files, pages

ROWS_SQL = """r AS (SELECT l_orderkey AS key, l_partkey AS part, l_linenumber AS pos, CAST(max(l_quantity) AS BIGINT) AS qty, CAST(floor(max(l_extendedprice)) AS BIGINT) AS sum_kop
    FROM lineitem GROUP BY ALL)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("pos"))
    return g.agg(F.max("l_quantity").cast("long").alias("qty"), F.floor(F.max("l_extendedprice")).alias("sum_kop"))


def _money(kopecks: Column) -> Column:
    return F.concat(F.floor(kopecks / 100).cast("string"), F.lit(","), F.lpad((kopecks % 100).cast("string"), 2, "0"))


@query(f"WITH {ROWS_SQL} SELECT CAST(key AS VARCHAR) AS key, 'item ' || part || '-' || pos AS name, CAST(qty AS DOUBLE) AS qty, sum_kop / 100.0 AS total FROM r")
def receipt_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as JSON bundles with integer kopecks; every third is listed a hundred times dearer than its rows say."""
    r = rows(spark, sf_dir)
    off = F.when(F.col("key") % 3 == 0, 100).otherwise(1)
    item = F.struct(F.concat(F.lit("item "), "part", F.lit("-"), "pos").alias("name"), F.col("qty").alias("quantity"), F.when(off == 1, F.col("sum_kop").cast("string")).otherwise(F.format_string("%.4f", F.col("sum_kop") / 10000)).alias("sum"))
    one = r.groupBy("key").agg(F.collect_list(item).alias("items"), F.sum("sum_kop").alias("all"))
    doc = F.to_json(F.struct(F.array(F.struct(F.col("key").cast("string").alias("key"), F.lit("2024-05-01").alias("date"), F.lit("s").alias("store"), F.col("all").cast("string").alias("total"))).alias("catalogue"),
                             F.array(F.struct(F.col("key").cast("string").alias("key"), F.struct("items").alias("fiscalData"))).alias("receipts")))
    return files.receipt_bundle(one.select(doc.alias("value"))).select("key", "name", "qty", "total")


@query(f"WITH {ROWS_SQL} SELECT key, 'item ' || part || '-' || pos AS name, CAST(qty AS DOUBLE) AS qty, sum_kop / 100.0 AS total, (SELECT sum(sum_kop) FROM r s WHERE s.key = r.key) / 100.0 AS declared FROM r")
def receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as printed text, one line a position and a total line."""
    line = F.concat(F.lit("item "), "part", F.lit("-"), "pos", F.lit(" "), F.col("qty").cast("string"), F.lit(" x 1,00 = "), _money(F.col("sum_kop")))
    text = rows(spark, sf_dir).groupBy("key").agg(F.array_join(F.collect_list(line), "\n").alias("lines"), F.sum("sum_kop").alias("all"))
    raw = text.select("key", F.concat(F.lit("SHOP\n"), "lines", F.lit("\nИТОГО: "), _money(F.col("all"))).alias("text"))
    return files.receipt_lines(raw).select("key", "name", "qty", "total", "declared")


@query(f"WITH {ROWS_SQL} SELECT key, 'item ' || part || '-' || pos AS name, CAST(CASE WHEN pos % 3 = 0 THEN qty ELSE 1 END AS DOUBLE) AS qty, sum_kop / 100.0 AS price FROM r")
def pasted_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted lines in three shapes: with a quantity, with a separator, and with the price at the end."""
    name = F.concat(F.lit("item "), "part", F.lit("-"), "pos")
    line = F.when(F.col("pos") % 3 == 0, F.concat_ws(";", name, "qty", _money(F.col("sum_kop")))).when(F.col("pos") % 3 == 1, F.concat_ws("\t", name, _money(F.col("sum_kop")))).otherwise(F.concat(name, F.lit(" "), _money(F.col("sum_kop")), F.lit(" ₽")))
    raw = rows(spark, sf_dir).groupBy("key").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return files.pasted_lines(raw).filter("ok").select("key", "name", "qty", "price")


#: Keys of parts that go into one bundle of a brand; with the rows that are sent twice a bundle stays far below its limit.
BUNDLED_KEYS = 10_000


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS sku, CASE WHEN p_partkey % 11 = 0 THEN 'no price' WHEN p_partkey % 7 = 0 THEN 'no name' END AS skipped FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'repeated' FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 7 > 0 AND p_partkey % 11 > 0
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 11 = 0 THEN 'no price' ELSE 'no name' END FROM part WHERE p_partkey % 13 = 0 AND (p_partkey % 7 = 0 OR p_partkey % 11 = 0)"""
)
def price_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price bundles of a brand and a range of keys each, some rows without a name or a price and some twice. A bundle is one shop's
    document and refused when it is too long, so a brand's rows are sent in as many as it takes, copies of a row in the same one."""
    k = F.col("p_partkey")
    item = F.struct(k.cast("string").alias("sku"), F.when((k % 7 != 0) | (k % 11 == 0), F.col("p_name")).alias("name"), F.when(k % 11 == 0, "0").otherwise("9,99").alias("price"))
    part = table(spark, sf_dir, "part")
    twice = part.withColumn("n", F.explode(F.when(k % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    raw = twice.groupBy("p_brand", F.floor(k / BUNDLED_KEYS)).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("value"))
    return files.price_bundle(raw).select("sku", "skipped")


@query("SELECT o_orderkey AS cart, CAST(floor(o_totalprice) AS DOUBLE) AS total, CAST(o_custkey % 300 AS DOUBLE) AS delivery FROM orders")
def cart_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart pages as lines; an old total and delivery stand far above the last ones."""
    far = F.array_repeat(F.lit("товар"), 14)
    o = table(spark, sf_dir, "orders")
    lines = F.concat(F.array(F.lit("Доставка 1 ₽"), F.lit("Итого 5 ₽")), far, F.array(F.concat(F.lit("Доставка "), (F.col("o_custkey") % 300).cast("string"), F.lit(" ₽")), F.concat(F.lit("К оплате "), F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", " "), F.lit(" ₽"))))
    return pages.cart_total(o.select(F.col("o_orderkey").alias("cart"), F.posexplode(lines).alias("position", "line")), "cart").select("cart", "total", "delivery")


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey + 1 AS id, CASE WHEN p_partkey + 1 > 3 THEN (p_partkey + 1) // 3 END AS parent, 'c' || (p_partkey + 1) AS name FROM part),
    w AS (SELECT id, name AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.id, w.path || '>' || e.name FROM w JOIN e ON e.parent = w.id)
    SELECT id, path FROM w WHERE id NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL)"""
)
def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") + 1
    e = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 3, F.floor(k / 3)).alias("parent"), F.concat(F.lit("c"), k).alias("name"))
    return pages.category_leaves(e).select("id", F.array_join("path", ">").alias("path"))


@query(
    """SELECT page_id, trim(translate(list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'), lambda x: regexp_matches(x, '[^0-9]'))[-1], '-_', '  ')) AS name FROM pages"""
)
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part of an address that is no number, as words."""
    return table(spark, sf_dir, "pages").select("page_id", pages.name_of(F.col("url")).alias("name"))


@query("SELECT host, count(*) AS pages FROM (SELECT regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]+)', 1), '^(www|m)\\.', '') AS host FROM pages) GROUP BY host")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(pages.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query(
    """SELECT CASE WHEN l_partkey % 5 > 0 THEN CAST(l_partkey AS VARCHAR) END AS sku, CASE WHEN l_partkey % 5 = 0 THEN 'no sku' END AS rejected,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE true END AS stock, CASE WHEN l_returnflag = 'A' THEN floor(l_extendedprice) END AS named_price, count(*) AS n FROM lineitem GROUP BY ALL"""
)
def device_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart reports of devices, one for each line item: landed lines name a price, unlanded ones say nothing of stock."""
    f = F.col("l_returnflag")
    line = F.struct(F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey").cast("string")).alias("sku"), F.floor("l_extendedprice").cast("double").alias("price"), F.when(f == "A", True).alias("landed"), F.when(f == "N", True).alias("in_stock"))
    doc = F.to_json(F.struct(F.lit("m").alias("chain"), F.lit("b").alias("basket"), F.lit("2024-05-01T00:00:00").alias("at"), F.array(line).alias("lines")))
    li = table(spark, sf_dir, "lineitem")
    out = device.report_lines(li.select(doc.alias("value")))
    return out.groupBy("sku", "rejected", "stock", "named_price").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, replace(replace(replace(replace(replace(replace(lower(p_name), 'ch', 'c'), 'sh', 's'), 'ts', 'c'), 'x', 'ks'), 'y', 'i'), 'j', 'i') AS folded FROM part WHERE NOT regexp_matches(lower(p_name), 'shch|sch|zh|kh|yu|ya|ye|yo|jj')")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(~F.lower("p_name").rlike("shch|sch|zh|kh|yu|ya|ye|yo|jj")).select("p_partkey", t.fold(F.col("p_name")).alias("folded"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey / 100.0 ELSE CAST(o_custkey AS DOUBLE) END AS money FROM orders")
def receipt_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer is kopecks, a fraction is roubles."""
    k = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", p.receipt_money(F.when(F.col("o_orderkey") % 2 == 0, k).otherwise(F.concat(k, F.lit(".00")))).alias("money"))


@query(
    """SELECT state, count(*) AS receipts FROM (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'other_store' ELSE 'imported' END AS state FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 3 > 0 GROUP BY ALL) GROUP BY 1"""
)
def receipt_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import of receipts that are not known yet; those of other sellers are set aside."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    r = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("date"), "o_custkey", "l_partkey")
    _, events = receipts.store_receipts(r, r.filter("key % 3 = 0").select("key"), F.col("o_custkey") % 4 != 0)
    return events.groupBy("state").agg(F.count("key").alias("receipts"))
