"""Queries on catalogue state: upserts, dictionaries, aliases, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import graph, history, resolve, search
from basketry.registry import query, table

OLD_NEW_SQL = """
    o AS (SELECT p_partkey AS sku, p_name AS name, p_brand AS brand, p_retailprice AS price FROM part WHERE p_partkey % 3 > 0),
    n AS (SELECT p_partkey AS sku, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' new' ELSE p_name END AS name, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS brand,
                 CASE WHEN p_partkey % 7 > 0 THEN p_retailprice + p_partkey % 2 END AS price FROM part WHERE p_partkey % 3 < 2)"""


def old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = part.filter(k % 3 > 0).select(k.alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    new = part.filter(k % 3 < 2).select(k.alias("sku"), F.when(k % 4 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name")).alias("name"), F.when(k % 5 > 0, F.col("p_brand")).alias("brand"), F.when(k % 7 > 0, F.col("p_retailprice") + k % 2).alias("price"))
    return old, new


@query(
    f"""WITH {OLD_NEW_SQL}, b AS (SELECT coalesce(o.sku, n.sku) AS sku, o.sku IS NULL AS is_new, n.sku IS NULL AS is_old, CASE WHEN n.sku IS NOT NULL THEN n.name ELSE o.name END AS name,
        coalesce(n.brand, o.brand) AS brand, coalesce(n.price, o.price) AS price, o.name AS on_, o.brand AS ob, o.price AS op FROM o FULL JOIN n ON o.sku = n.sku)
    SELECT sku, name, brand, price, CASE WHEN is_new THEN 'added' WHEN is_old THEN 'untouched' WHEN name = on_ AND brand IS NOT DISTINCT FROM ob AND price IS NOT DISTINCT FROM op THEN 'same' ELSE 'changed' END AS action FROM b"""
)
def upsert_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_new(spark, sf_dir)
    return history.upsert(old, new, ["sku"], ("name",), ("brand", "price"))


@query(
    f"""WITH {OLD_NEW_SQL} SELECT coalesce(n.sku, o.sku) AS sku, CASE WHEN o.sku IS NULL THEN 'inserted' WHEN n.sku IS NULL THEN 'deleted'
        WHEN o.name = n.name AND o.price IS NOT DISTINCT FROM n.price THEN 'same' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.sku = n.sku"""
)
def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_new(spark, sf_dir)
    return resolve.write_back(old, new, "sku", ["name", "price"]).select("sku", "change")


@query("SELECT p_partkey AS sku, p_brand AS chain, NOT (p_brand = 'Brand#11' AND p_partkey % 3 = 0) AS active FROM part")
def retire_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete run of one chain saw all but every third product."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(k.alias("sku"), F.col("p_brand").alias("chain"), F.lit(True).alias("active"), F.when(k % 3 == 0, F.lit("2024-01-01")).otherwise("2024-02-01").cast("timestamp").alias("last_seen"))
    return history.retire_unseen(c, "Brand#11", F.lit("2024-01-15").cast("timestamp"), True).select("sku", "chain", "active")


@query(
    """SELECT p_partkey AS item_id, p_name AS name, CASE WHEN lower(p_name) = 'blue' OR starts_with(lower(p_name), 'blue ') THEN 0 WHEN starts_with(lower(p_name), 'blue') THEN 1 WHEN contains(lower(p_name), ' blue') THEN 2 ELSE 3 END AS place
    FROM part WHERE contains(lower(p_name), 'blue') ORDER BY place, p_size DESC, length(p_name), p_partkey LIMIT 30"""
)
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_size").alias("chains"))
    return search.ranked(items, "blue", 30).select("item_id", "name", "place")


@query(
    """SELECT p_partkey AS item_id, contains(' ' || lower(p_name), ' blu')::INT + contains(' ' || lower(p_name), ' gre')::INT AS matches FROM part
    WHERE contains(' ' || lower(p_name), ' blu') OR contains(' ' || lower(p_name), ' gre') ORDER BY matches DESC, length(p_name), p_partkey LIMIT 30"""
)
def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.lower("p_name").alias("folded"))
    return search.folded(items, "blu gre", 30, F.col("folded")).select("item_id", "matches")


@query(
    """WITH own AS (SELECT p_name AS name, p_partkey AS rank FROM part WHERE p_partkey % 11 = 0 ORDER BY rank, name LIMIT 10),
    b AS (SELECT 0 AS source, rank, name FROM own UNION ALL SELECT 1, p_partkey, upper(p_name) FROM part)
    SELECT source, rank, name FROM b QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY source, rank, name) = 1 ORDER BY source, rank, name LIMIT 20"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    own = part.filter("p_partkey % 11 = 0").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("rank"))
    return search.hybrid(own, part.select(F.upper("p_name").alias("name"), F.col("p_partkey").alias("rank")), 20)


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS rows FROM documents GROUP BY text")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))


@query(
    """SELECT kind, name, count(*) AS rows FROM (SELECT 'part' AS kind, p_brand AS name FROM part UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'region', r_name FROM region) GROUP BY ALL"""
)
def spelling_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of spellings from several tables."""
    src = lambda t, c: table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(c).alias("name"))
    return src("part", "p_brand").unionByName(src("nation", "n_name")).unionByName(src("region", "r_name")).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("rows"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 2 * l_partkey AS a, 2 * l_suppkey + 1 AS b FROM lineitem),
    two AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM two
      UNION SELECT two.b, min(c.component) FROM c JOIN two ON two.a = c.node JOIN recurring.c AS r ON r.node = two.b WHERE c.component < r.component GROUP BY two.b)
    SELECT node, component FROM c"""
)
def match_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of parts and suppliers over all line items; a part k is node 2k and a supplier k is node 2k + 1."""
    li = table(spark, sf_dir, "lineitem")
    return graph.components(li.select((2 * F.col("l_partkey")).alias("a"), (2 * F.col("l_suppkey") + 1).alias("b")))


@query(
    """WITH RECURSIVE a AS (SELECT p_partkey AS old, p_partkey // 2 AS new FROM part WHERE p_partkey % 5 > 0), w AS (SELECT old, new AS target, 1 AS hops FROM a
    UNION ALL SELECT w.old, a.new, hops + 1 FROM w JOIN a ON a.old = w.target WHERE hops < 16)
    SELECT old, CASE WHEN target > 0 AND target % 5 = 0 THEN target END AS target FROM w QUALIFY row_number() OVER (PARTITION BY old ORDER BY hops DESC) = 1"""
)
def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    return graph.resolve_aliases(part.filter(k % 5 > 0).select(k.alias("old"), F.floor(k / 2).alias("new")), part.filter((k > 0) & (k % 5 == 0)).select(k.alias("id")))


@query(None)
def resolve_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity resolution over part names, a fourth of them under two chains: items, their names and sizes."""
    k = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(k.alias("id"), F.concat_ws(" ", "p_name", F.concat(F.col("p_size") * 10, F.lit(" г"))).alias("name"), F.col("p_brand").alias("brand"))
    twin = base.filter("id % 4 = 0").withColumn("id", F.col("id") + 100_000_000)
    rows = base.withColumn("chain", F.lit("a")).unionByName(twin.withColumn("chain", F.lit("b")))
    rows = rows.withColumns({"weight_g": F.lit(None).cast("double"), "unit": F.lit("pcs"), "barcode": F.lit(None).cast("string"), "item_id": F.when(F.col("id") % 3 == 0, F.col("id"))})
    return resolve.match_all(rows)
