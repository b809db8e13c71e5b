"""Spellings, titles and other lists around items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions import text as t
from basketry.functions.titles import human_name


def variant_stats(variants: DataFrame) -> DataFrame:
    return variants.groupBy("source").agg(F.count(F.lit(1)).alias("variants"), F.countDistinct("item_id").alias("items"), F.sum("hits").alias("hits"))


def item_totals(catalog: DataFrame) -> DataFrame:
    """Items, and items that two chains or more list."""
    per = catalog.filter("active and item_id is not null").groupBy("item_id").agg(F.countDistinct("chain").alias("chains"))
    return per.agg(F.count("item_id").alias("items"), F.count_if(F.col("chains") > 1).alias("shared"))


def receipt_variants(mappings: DataFrame, history: DataFrame) -> DataFrame:
    """Spellings of items on receipts: those seen when mapped and those of the history, with their observations."""
    both = mappings.select("item_id", F.col("seen_name").alias("variant"), "at").unionByName(history.select("item_id", F.col("raw_name").alias("variant"), "at"))
    both = both.filter("variant is not null and item_id is not null").withColumn("folded", F.array_join(t.fold_words(t.ordered_words(F.col("variant"))), " "))
    return both.groupBy("item_id", "folded").agg(F.min_by("variant", F.struct("at", "variant")).alias("variant"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("hits"))


def search_variants(variants: DataFrame, items: DataFrame, query: str, limit: int) -> DataFrame:
    """Live items by their spellings: one row a spelling, the most matching folded words first."""
    from basketry.operators.search import folded

    live = variants.join(items.select("item_id"), "item_id", "left_semi")
    return folded(live, query, limit, F.col("folded"), "item_id")


def contradicting(receipts: DataFrame) -> DataFrame:
    """Products (product_id) whose receipt spellings, the same once normalised, differ in glued negations."""
    words = t.fold_words(t.ordered_words(t.glue(F.col("raw_name"))))
    r = receipts.select("product_id", t.normalize_name(F.col("raw_name")).alias("name"), words.alias("w")).distinct()
    return r.groupBy("product_id", "name").agg(F.count_distinct("w").alias("n")).filter("n > 1").select("product_id").distinct()


def human_titles(history: DataFrame) -> DataFrame:
    """A readable title for each product from its latest receipt line."""
    last = history.groupBy("product_id").agg(F.max_by("raw_name", F.struct("day", "id")).alias("raw_name"))
    return last.select("product_id", human_name(F.col("raw_name")).alias("title"))


def photos(own: DataFrame, item_rows: DataFrame) -> DataFrame:
    """A picture for each product: its own, else the first of its item's that is an address."""
    web = lambda c: F.when(F.col(c).rlike("^https?://"), F.col(c))
    first = item_rows.withColumn("image", web("image")).filter("image is not null").groupBy("product_id").agg(F.min_by("image", F.struct("chain", "sku")).alias("shared"))
    return own.select("product_id", web("image").alias("image")).join(first, "product_id", "full_outer").select("product_id", F.coalesce("image", "shared").alias("image"))


def basket_products(baskets: DataFrame, items: DataFrame, last: int) -> DataFrame:
    """Distinct products of each workspace's last baskets: what a watch refreshes."""
    w = Window.partitionBy("workspace").orderBy(F.desc("created_at"), F.desc("basket_id"))
    recent = baskets.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= last)
    return items.join(recent.select("basket_id", "workspace"), "basket_id").select("workspace", "product_id").distinct()


def watch_pass(products: DataFrame, fresh: DataFrame, asked: DataFrame) -> DataFrame:
    """What to ask for: watched products without a fresh price that were not asked for lately."""
    key = ["workspace", "product_id", "chain"]
    return products.join(fresh.select(*key), key, "left_anti").join(asked.select(*key), key, "left_anti")


def offers_map(offers: DataFrame, most: int = 10) -> DataFrame:
    """Each store's valid offers, the best first."""
    o = F.array_sort(F.collect_list(F.struct((-F.col("percent")).alias("neg"), "offer_id", "percent")))
    return offers.groupBy("store").agg(F.transform(F.slice(o, 1, most), lambda x: x["offer_id"]).alias("offers"))


def workspace_document(workspaces: DataFrame, baskets: DataFrame, items: DataFrame) -> DataFrame:
    """A workspace as one JSON document of its baskets and their lines."""
    lines = items.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct("product_id", "qty"))).alias("lines"))
    own = baskets.join(lines, "basket_id", "left").groupBy("workspace").agg(F.array_sort(F.collect_list(F.struct("basket_id", "lines"))).alias("baskets"))
    return workspaces.join(own, "workspace", "left").select("workspace", F.to_json(F.struct("workspace", "baskets")).alias("document"))


def item_rows(catalog: DataFrame, items: DataFrame, live: bool = True) -> DataFrame:
    """Catalogue rows of items, the living ones or all."""
    rows = catalog.join(items.select("item_id").distinct(), "item_id", "left_semi")
    return rows.filter("active") if live else rows


def rows_by_gtin(catalog: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows whose trusted barcode is among the given ones, however either writes it."""
    key = t.gtin(F.col("barcode"))
    rows = catalog.withColumn("key", F.when(t.gtin_trusted(key), key))
    return rows.join(codes.select(t.gtin(F.col("barcode")).alias("key")).distinct(), "key", "left_semi").drop("key")


def unmatched(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("chain").agg(F.count_if(F.col("active") & F.col("item_id").isNull()).alias("unmatched"))


def price_history(prices: DataFrame, mapping: DataFrame, days: int, now) -> DataFrame:
    """A product's prices through its chosen mappings, oldest first."""
    own = prices.join(mapping.select("product_id", "chain", "sku"), ["chain", "sku"])
    return own.filter(F.col("seen_at") >= now - F.expr(f"INTERVAL {days} DAYS")).select("product_id", "chain", "seen_at", "price").orderBy("product_id", "chain", "seen_at")


def without_base(mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings without what the base only proposed, and those proposals."""
    proposed = (F.col("method") == "master") & ~F.col("confirmed")
    return mappings.filter(~proposed), mappings.filter(proposed)
