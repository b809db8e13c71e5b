"""Carts: what can be ordered where, plans and their check, coupons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.similarity import may_be_similar, similarity
from basketry.operators.market import in_each
from basketry.operators.tiles import tiled_join

NAMED_ALIKE = 0.8


def item_status(items: DataFrame, mappings: DataFrame, prices: DataFrame, stores: DataFrame) -> DataFrame:
    """basket_id, product_id, store, status: NOT_KNOWN (no mapping), NO_DATA (no fresh price), GONE (out of stock), HAVE.

    A status is one of a product in a store, so it is found once for each and put beside the items; only items move, not their pairs.
    """
    wanted = in_each(items.select("product_id").distinct(), stores, "store")
    m = mappings.select("product_id", "store", F.lit(True).alias("known")).distinct()
    p = prices.select("product_id", "store", "price", "in_stock")
    out = wanted.join(m, ["product_id", "store"], "left").join(p, ["product_id", "store"], "left")
    status = F.when(F.col("known").isNull(), "NOT_KNOWN").when(F.col("price").isNull(), "NO_DATA").when(~F.coalesce("in_stock", F.lit(True)), "GONE").otherwise("HAVE")
    known = out.select(F.col("product_id").alias("_product"), "store", status.alias("status"))
    return items.select("basket_id", "product_id").join(known, F.col("product_id").eqNullSafe(F.col("_product"))).select("basket_id", "product_id", "store", "status")


def substitutes(status: DataFrame, fallback: DataFrame) -> DataFrame:
    """Lines that a shop lacks and whose substitute of the same unit it has: basket_id, product_id, store, substitute."""
    lacking = status.filter(F.col("status").isin("NOT_KNOWN", "GONE"))
    f = fallback.filter(F.col("unit") == F.col("sub_unit")).select("basket_id", "product_id", "substitute")
    have = status.filter(F.col("status").isin("HAVE", "NO_DATA")).select("basket_id", F.col("product_id").alias("substitute"), "store")
    return lacking.select("basket_id", "product_id", "store").join(f, ["basket_id", "product_id"]).join(have, ["basket_id", "substitute", "store"], "left_semi").select("basket_id", "product_id", "store", "substitute")


def plan(lines: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with a real SKU, and lines no SKU is known for."""
    key = ["product_id", "store"]
    return lines.join(mappings.select(*key, "sku"), key), lines.join(mappings.select(*key), key, "left_anti")


def verify(old: DataFrame, new: DataFrame, step: float = 0.004) -> DataFrame:
    """Plan lines (basket_id, sku, price) after a refresh: same, changed or gone."""
    n = new.select("basket_id", "sku", F.col("price").alias("new_price"), F.col("in_stock").alias("new_stock"))
    out = old.join(n, ["basket_id", "sku"], "left")
    gone = F.col("new_price").isNull() | ~F.coalesce("new_stock", F.lit(True))
    return out.withColumn("change", F.when(gone, "gone").when(F.abs(F.col("new_price") - F.col("price")) > step, "changed").otherwise("same"))


def stamp(lines: DataFrame) -> DataFrame:
    """A basket's stamp: first 12 hex digits of SHA-1 over its sorted product and quantity pairs."""
    pair = F.concat_ws(":", F.col("product_id").cast("string"), F.format_string("%.3f", F.col("qty").cast("double")))
    return lines.groupBy("basket_id").agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(pair)), ",")), 1, 12).alias("stamp"))


def coupon_price(price: Column, coupon: Column, percent: Column, off: Column) -> Column:
    """The price after a coupon: a set price, a percentage or an amount off; never higher than before, never below zero."""
    after = F.coalesce(coupon, price * (1 - percent / 100), price - off, price)
    return F.round(F.greatest(F.lit(0.0), F.least(price, after)), 2)


def best_coupons(prices: DataFrame, coupons: DataFrame) -> DataFrame:
    """Prices (store, sku, price) after the lowest coupon of the store's SKU."""
    j = prices.join(coupons, ["store", "sku"], "left").withColumn("after", coupon_price(F.col("price"), F.col("coupon_price"), F.col("percent"), F.col("off")))
    return j.groupBy("store", "sku", "price").agg(F.min("after").alias("my_price"), F.min_by("coupon_id", F.struct("after", "coupon_id")).alias("coupon_id"))


def best_named_coupons(prices: DataFrame, coupons: DataFrame) -> DataFrame:
    """Prices (store, sku, name, price) after the lowest coupon (store, coupon_id, product, coupon_price, percent, off) whose
    product is named alike, for coupons that list no SKU. Every coupon of a shop meets every name of it, in tiles by their counts.
    """
    c = coupons.filter("trim(coalesce(product, '')) <> ''").withColumn("_row", F.xxhash64("coupon_id"))
    named = prices.select("store", "name").filter("trim(coalesce(name, '')) <> ''").distinct().withColumn("_row", F.xxhash64("name"))
    met = tiled_join(named, c, ["store"], row="_row").select("a.store", "a.name", *[f"b.{x}" for x in ("product", "coupon_id", "coupon_price", "percent", "off")])
    met = met.filter(may_be_similar(F.col("product"), F.col("name"), NAMED_ALIKE))
    fits = met.filter(similarity(F.col("product"), F.col("name")) >= NAMED_ALIKE).select("store", "name", "coupon_id", "coupon_price", "percent", "off")
    j = prices.join(fits, ["store", "name"], "left").withColumn("after", coupon_price(F.col("price"), F.col("coupon_price"), F.col("percent"), F.col("off")))
    return j.groupBy("store", "sku", "name", "price").agg(F.min("after").alias("my_price"), F.min_by("coupon_id", F.struct("after", "coupon_id")).alias("coupon_id"))


def merge_coupons(old: DataFrame, report: DataFrame, today: Column) -> DataFrame:
    """A new report replaces the active coupons; expired ones stay unless it names them."""
    return report.unionByName(old.filter(F.col("valid_to") < today).join(report.select("coupon_id"), "coupon_id", "left_anti"))


def device_stock(flag: Column, landed: Column, words: Column) -> Column:
    """What a device saw: its own flag, else that it landed in the cart, else words of absence; null if it says nothing."""
    low = F.lower(F.coalesce(words, F.lit("")))
    return F.coalesce(flag, F.when(landed, True), F.when(low.rlike("нет в наличии|закончил|недоступ|раскупили|out of stock"), False))


def device_price(price: Column, landed: Column, own_card: Column) -> Column:
    return F.when((F.coalesce(landed, F.lit(False)) | F.coalesce(own_card, F.lit(False))) & (price > 0), price)


def price_sources(list_prices: DataFrame, history: DataFrame) -> DataFrame:
    """Price of (store, product): the price list's, else the last receipt's."""
    last = history.groupBy("store", "product_id").agg(F.max_by("unit_price", F.struct("day", "id")).alias("receipt_price"))
    out = list_prices.select("store", "product_id", F.col("price").alias("list_price")).join(last, ["store", "product_id"], "full_outer")
    return out.select("store", "product_id", F.coalesce("list_price", "receipt_price").alias("price"), F.when(F.col("list_price").isNotNull(), "list").otherwise("receipt").alias("source"))


def weighed_products(products: DataFrame, history: DataFrame, chain_rows: DataFrame) -> DataFrame:
    """product_id, weighed, by evidence: name, fractional receipts, whole receipts, how chains sell it."""
    from basketry.functions.prices import weighed_by_evidence
    from basketry.functions.text import unit_from_name

    h = history.groupBy("product_id").agg(F.max(F.col("qty") != F.floor("qty")).alias("fractional"), F.min(F.col("qty") == F.floor("qty")).alias("whole"))
    c = chain_rows.groupBy("product_id").agg((F.sum((F.col("unit") == "kg").cast("int")) * 2 > F.count("unit")).alias("chains"))
    out = products.join(h, "product_id", "left").join(c, "product_id", "left")
    return out.select("product_id", weighed_by_evidence(unit_from_name(F.col("name")), F.coalesce("fractional", F.lit(False)), F.coalesce("whole", F.lit(False)), F.col("chains")).alias("weighed"))


def phone_plan(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """What a phone puts into a cart: the SKU where one is known, search terms in any case; no services."""
    from basketry.functions.prices import pieces
    from basketry.operators.matching import search_terms
    from basketry.operators.receipts import is_service

    goods = lines.filter(~is_service(F.col("name"))).join(mappings.select("product_id", "store", "sku", "pack_g"), ["product_id", "store"], "left")
    times = pieces(F.col("qty"), F.coalesce("pack_g", F.lit(0.0)), F.col("unit"), 30)
    return goods.select("basket_id", "product_id", "store", "sku", times.alias("times"), search_terms(F.col("name"), F.col("pack_g")).alias("terms"))


def quotes(reports: DataFrame) -> DataFrame:
    """Chain quotes as structs: status (whole, partial, none), fees, discount and the names a chain did not have."""
    status = F.when(F.col("total").isNull(), "none").when(F.size("missing") > 0, "partial").otherwise("whole")
    body = F.struct("total", F.coalesce("delivery", F.lit(0.0)).alias("delivery"), F.coalesce("service_fee", F.lit(0.0)).alias("service_fee"), F.coalesce("discount", F.lit(0.0)).alias("discount"), F.array_sort("missing").alias("missing"))
    return reports.select("basket_id", "store", status.alias("status"), F.to_json(body).alias("quote"))
