"""One product across shops, and baskets built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import text as t
from basketry.functions.prices import line_price, per_unit_price
from basketry.functions.similarity import similarity
from basketry.operators.market import in_each, with_sanity
from basketry.operators.search import relevant
from basketry.session import dealt


def compare_products(products: DataFrame, stores: DataFrame, mappings: DataFrame, prices: DataFrame) -> DataFrame:
    """Every product in every store: price, unit price and note (not mapped, no fresh price, out of stock, odd price)."""
    rows = products.count() * stores.select("store").distinct().count()
    # mappings and prices are tables as large as the answer, whatever their files: merged in tasks by their rows, never sent to every task
    priced = dealt(mappings.select("product_id", "store", "sku", "unit", "weight_g"), rows, "store", "sku").join(prices.select("store", "sku", "price", "in_stock").hint("merge"), ["store", "sku"], "left")
    every = dealt(in_each(products.select("product_id"), stores, "store"), rows, "product_id", "store")
    out = dealt(every.join(priced.hint("merge"), ["product_id", "store"], "left"), rows, "product_id")
    unit = per_unit_price(F.col("price"), F.col("unit"), F.col("weight_g"))
    out = with_sanity(out.withColumn("u", unit).withColumn("per_unit", F.col("u.value")).withColumn("label", F.col("u.label")).drop("u"), ["product_id"], "per_unit")
    note = F.when(F.col("sku").isNull(), "not mapped").when(F.col("price").isNull(), "no fresh price").when(~F.coalesce("in_stock", F.lit(True)), "out of stock").when(~F.col("sane"), "odd price")
    return out.select("product_id", "store", "sku", "price", "per_unit", "label", note.alias("note"))


def compare_query(query: str, found: DataFrame) -> DataFrame:
    """A shop's results (name, price, unit, weight_g) that are about the query, with their unit price."""
    q = F.lit(query)
    size_q, size_n = t.weight_g(q), t.weight_g(F.col("name"))
    agree = F.coalesce(F.abs(size_n - size_q) / size_q <= 0.2, F.lit(True))
    kept = found.withColumn("score", similarity(q, F.col("name"))).filter(relevant(t.ordered_words(q), t.ordered_words(F.col("name")), F.col("score"), agree))
    return kept.withColumn("per_unit", per_unit_price(F.col("price"), F.col("unit"), F.coalesce("weight_g", size_n))["value"])


def resolve_description(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked_id, id, method, score: the item row that a prepared description is the same product as, the best one."""
    from basketry.operators.resolve import same_product

    head = lambda df: df.withColumn("head", F.explode(F.slice("forder", 1, 2)))
    pairs = head(asked).alias("a").join(head(rows).alias("b"), F.col("a.head") == F.col("b.head")).withColumn("s", same_product()).filter("s.ok")
    return pairs.groupBy(F.col("a.id").alias("asked_id")).agg(F.max_by(F.struct(F.col("b.id").alias("id"), "s.method", "s.score"), F.struct("s.score", -F.col("b.id"))).alias("r")).select("asked_id", "r.*")


def basket_lines(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Priced lines of baskets: items (basket_id, product_id, qty, weighed, ref_g) and fresh prices by product and store."""
    j = items.join(prices, "product_id")
    value = line_price(*[F.col(c) for c in ("price", "per_kg", "shop_unit", "pack_g", "qty", "weighed", "ref_g", "portions", "by_weight")])
    out = j.withColumn("line", value).select("basket_id", "product_id", "store", F.col("line.value").alias("value"), F.col("line.adjust").alias("adjust"), "in_stock")
    return with_sanity(out, ["basket_id", "product_id"], "value").filter("sane or value is null").drop("sane")


def covered_baseline(baseline: DataFrame, missing: DataFrame) -> DataFrame:
    """What the covered part of a basket usually costs: lines (basket_id, product_id, baseline) less those missing in a variant."""
    whole = baseline.groupBy("basket_id").agg(F.sum("baseline").alias("whole"))
    less = missing.join(baseline, ["basket_id", "product_id"]).groupBy("basket_id", "variant").agg(F.sum("baseline").alias("less"))
    every = missing.select("basket_id", "variant").distinct().join(whole, "basket_id").join(less, ["basket_id", "variant"], "left")
    return every.select("basket_id", "variant", F.round(F.greatest(F.lit(0.0), F.col("whole") - F.coalesce("less", F.lit(0.0))), 2).alias("baseline"))


def effortless(stores: DataFrame) -> DataFrame:
    """Stores that take a cart by link: what an effortless variant is built from."""
    return stores.filter(F.col("handover") == "LINK")


def board(variants: DataFrame, singles: DataFrame, most: int = 3) -> DataFrame:
    """Places of a basket from splits and single shops: dominated ones go, the rest are ranked with their gap to the best."""
    from basketry.operators.market import dominated, ranked_places

    every = variants.select("basket_id", "place", "missing", "total").unionByName(singles.select("basket_id", "place", "missing", "total"))
    return ranked_places(dominated(every, ["basket_id"]), ["basket_id"], most)


def partly_dominated(places: DataFrame, group: list[str]) -> DataFrame:
    """The milder rule: a place goes only if another has more of the basket and costs no more."""
    from basketry.operators.market import dominated

    return dominated(places, group, partly=True)


def available(price: Column, in_stock: Column) -> Column:
    return price.isNotNull() & F.coalesce(in_stock, F.lit(True))
