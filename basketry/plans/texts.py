"""Queries on names, pages and nested text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import prices as p
from basketry.functions import text as t
from basketry.operators import carts, link
from basketry.registry import query, table
from basketry.sources import pages


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.html_title(F.col("html")).alias("title"))


@query(
    """SELECT page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]+)', 1), '^(www|m)\\.', '') AS host,
    nullif(regexp_extract(url, '/[a-z]{2}/(\\d+)', 1), '') AS sku FROM pages"""
)
def url_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(d, r"/[a-z]{2}/(\d+)") for d in ("example.com", "example.net", "example.org")]
    return table(spark, sf_dir, "pages").select("page_id", pages.host(F.col("url")).alias("host"), pages.sku_of(F.col("url"), rules).alias("sku"))


@query(
    """SELECT p_partkey, TRY_CAST(replace(nullif(regexp_extract(s, '(\\d{1,2}(?:[.,]\\d)?)\\s*%', 1), ''), ',', '.') AS DOUBLE) AS percent, p_size * 10.0 AS grams FROM
    (SELECT p_partkey, p_size, p_name || ' ' || p_size || ',5 % ' || p_size * 10 || ' г' AS s FROM part)"""
)
def weight_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    name = F.concat("p_name", F.lit(" "), size, F.lit(",5 % "), (F.col("p_size") * 10).cast("string"), F.lit(" г"))
    return table(spark, sf_dir, "part").select("p_partkey", t.parse_percent(name).alias("percent"), t.weight_g(name).alias("grams"))


@query(
    """WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lpad(CAST(p_partkey * 7919 % 1000000000000 AS VARCHAR), 12, '4') WHEN 1 THEN '46 ' || lpad(CAST(p_partkey * 104729 % 100000000000 AS VARCHAR), 11, '0')
        WHEN 2 THEN lpad(CAST(p_partkey AS VARCHAR), 8, '9') ELSE CAST(p_partkey AS VARCHAR) END AS code FROM part),
    g AS (SELECT p_partkey, CASE WHEN length(d) IN (8, 12, 13, 14) AND regexp_matches(d, '[1-9]') THEN lpad(d, 14, '0') END AS gtin FROM (SELECT p_partkey, regexp_replace(code, '\\D', '', 'g') AS d FROM c))
    SELECT p_partkey, gtin, coalesce(gtin IS NOT NULL AND (10 - list_sum(list_transform(range(1, 14), lambda i: CAST(substr(gtin, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(substr(gtin, 14, 1) AS INT)
      AND NOT CASE WHEN starts_with(gtin, '000000') THEN substr(gtin, 7, 1) IN ('0', '2')
                   WHEN starts_with(gtin, '0') THEN substr(gtin, 2, 1) = '2' OR substr(gtin, 2, 2) IN ('02', '04', '05', '98', '99') ELSE false END, false) AS trusted FROM g"""
)
def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    code = F.when(k % 4 == 0, F.lpad(s(k * 7919 % 1_000_000_000_000), 12, "4")).when(k % 4 == 1, F.concat(F.lit("46 "), F.lpad(s(k * 104729 % 100_000_000_000), 11, "0"))).when(k % 4 == 2, F.lpad(s(k), 8, "9")).otherwise(s(k))
    g = table(spark, sf_dir, "part").select("p_partkey", t.gtin(code).alias("gtin"))
    return g.withColumn("trusted", t.gtin_trusted(F.col("gtin")))


@query(
    """SELECT doc_id, word, n FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en') GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) <= 3"""
)
def frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent words of each English document."""
    from pyspark.sql.window import Window

    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    n = d.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))).filter("rn <= 3").drop("rn")


@query(
    """WITH w AS (SELECT p_partkey AS id, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+'))) AS word FROM part),
    top AS (SELECT word FROM w GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 20) SELECT id, word FROM w WHERE word NOT IN (SELECT word FROM top)"""
)
def generic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over the words of all names, without the twenty that say least."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]+"), F.lit(0)))
    return link.word_index(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), words.alias("fwords")), 20).select("id", "word")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS money FROM orders")
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written with thousands spaces and a decimal comma, read again."""
    written = F.concat(F.translate(F.format_number(F.round("o_totalprice", 2), 2), ",.", " ,"), F.lit(" ₽"))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.parse_money(written).alias("money"))


@query(
    """SELECT basket_id, substr(sha1(string_agg(pair, ',' ORDER BY pair)), 1, 12) AS stamp FROM (SELECT l_orderkey AS basket_id, l_partkey || ':' || printf('%.3f', CAST(l_quantity AS DOUBLE)) AS pair FROM lineitem) GROUP BY 1"""
)
def basket_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free mark of a basket's products: equal baskets, equal marks."""
    return carts.stamp(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("qty")))


@query("SELECT conv_id, count(*) AS lines, sum(length(text)) AS chars, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    roles = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("text")).alias("chars"), F.array_join(F.transform(roles, lambda r: r["role"]), ">").alias("roles"))
