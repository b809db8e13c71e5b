"""What devices and people report, and how it enters the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import address_key, placeholder_sku
from basketry.operators.carts import device_price, device_stock
from basketry.operators.history import latest_by

REPORT = "struct<chain:string,basket:string,at:timestamp,lines:array<struct<sku:string,name:string,price:double,qty:double,landed:boolean,own_card:boolean,in_stock:boolean,words:string>>>"


def report_lines(raw: DataFrame, column: str = "value") -> DataFrame:
    """Lines of JSON cart reports with stock and price as a device can know them, and why a line is not accepted."""
    r = raw.select(F.from_json(column, REPORT).alias("r"))
    rows = r.select("r.chain", "r.basket", "r.at", F.posexplode_outer("r.lines").alias("position", "l")).select("chain", "basket", "at", "position", "l.*")
    bad = F.when(F.coalesce("chain", F.lit("")) == "", "no chain").when(F.col("at").isNull(), "no time").when(F.coalesce("sku", F.lit("")) == "", "no sku").when(placeholder_sku(F.col("sku"), F.col("chain")), "placeholder")
    stock = device_stock(F.col("in_stock"), F.col("landed"), F.col("words"))
    return rows.withColumns({"rejected": bad, "stock": stock, "named_price": device_price(F.col("price"), F.col("landed"), F.col("own_card"))})


def learn_rows(catalog: DataFrame, lines: DataFrame, most: int = 20) -> DataFrame:
    """Accepted lines that the catalogue does not have, so many of each report at most (the newest report's limit is its own)."""
    new = lines.filter("rejected is null").join(catalog.select("chain", "sku"), ["chain", "sku"], "left_anti")
    from pyspark.sql.window import Window

    w = Window.partitionBy("chain", "basket", "at").orderBy("position")
    return new.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def set_values(catalog: DataFrame, seen: DataFrame, at: Column, revive: bool = False) -> DataFrame:
    """Stock and price of seen rows (chain, sku, stock, named_price): only known values, only active rows unless they are revived."""
    s = seen.groupBy("chain", "sku").agg(F.max_by("stock", F.when(F.col("stock").isNotNull(), F.col("at"))).alias("stock"), F.max_by("named_price", F.when(F.col("named_price").isNotNull(), F.col("at"))).alias("named"))
    out = catalog.join(s.withColumn("hit", F.lit(True)), ["chain", "sku"], "left")
    may = F.coalesce("hit", F.lit(False)) & (F.lit(revive) | F.col("active"))
    return out.select(
        *[c for c in catalog.columns if c not in ("in_stock", "price", "price_seen", "active", "last_seen")],
        F.when(may, F.coalesce("stock", "in_stock")).otherwise(F.col("in_stock")).alias("in_stock"),
        F.when(may, F.coalesce("named", "price")).otherwise(F.col("price")).alias("price"),
        F.when(may & F.col("named").isNotNull(), at).otherwise(F.col("price_seen")).alias("price_seen"),
        (F.col("active") | (may & F.lit(revive))).alias("active"),
        F.when(may, at).otherwise(F.col("last_seen")).alias("last_seen"),
    ).select(*catalog.columns)


def mirror(personal: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Personal prices of rows that the shared catalogue knows, and the count of the others by chain."""
    real = personal.filter(~placeholder_sku(F.col("sku"), F.col("chain")))
    known = catalog.select("chain", "sku")
    return real.join(known, ["chain", "sku"], "left_semi"), real.join(known, ["chain", "sku"], "left_anti").groupBy("chain").count()


def before_move(fetched_at: Column, moved_at: Column, chain: Column, point_chains: list[str]) -> Column:
    """A price from before the person moved, of a chain that prices by point."""
    return chain.isin(point_chains) & F.coalesce(fetched_at < moved_at, F.lit(False))


def network_total(reports: DataFrame) -> DataFrame:
    """A cart's own total: to pay, else total, else goods plus delivery; implausible ones are none."""
    value = F.coalesce("to_pay", "total", F.col("goods") + F.coalesce("delivery", F.lit(0.0)))
    return reports.withColumn("network_total", F.when(value.between(0, 10_000_000), value))


def remember_points(have: DataFrame, new: DataFrame) -> DataFrame:
    """The latest point of each chain and address; addresses agree in lower case and single spaces."""
    both = have.unionByName(new).withColumn("key", address_key(F.col("address")))
    return latest_by(both, ["chain", "key"], [F.desc("at"), F.desc("point")])


def import_prices(bundle: DataFrame, store: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted bundle rows as store products and as price snapshots."""
    ok = bundle.filter("skipped is null").withColumn("store", F.lit(store))
    return ok.select("store", "sku", "name", "unit", "weight_g"), ok.select("store", "sku", "price", "in_stock", at.alias("fetched_at"), F.lit("bundle").alias("source"))


def save_price_list(prices: DataFrame, path: str) -> None:
    """A price list as CSV that ``price_list`` reads again."""
    prices.select("name", F.format_string("%.2f", "price").alias("price")).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def without_ghosts(skus: DataFrame, children: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """SKU rows without previews, and child tables (with ``sku``) without the previews' rows."""
    ghost = skus.filter(F.lower("sku").rlike("-preview-[0-9]|^preview-")).select("sku")
    return skus.join(ghost, "sku", "left_anti"), [c.join(ghost, "sku", "left_anti") for c in children]


def fill_sizes(products: DataFrame) -> DataFrame:
    """Missing weight and unit from the name; what is known stays."""
    from basketry.functions.text import unit_from_name, weight_g

    return products.withColumns({"weight_g": F.coalesce("weight_g", weight_g(F.col("name"))), "unit": F.coalesce("unit", unit_from_name(F.col("name")))})


def portion_to_kilo(prices: DataFrame, before: Column) -> DataFrame:
    """Prices first seen before a version's day were of a portion: of a kilogram from then on. Run once, by that day."""
    old = (F.col("first_seen") < before) & (F.col("weight_g") > 0) & (F.col("unit") == "kg")
    return prices.withColumn("price", F.when(old, F.round(F.col("price") * 1000.0 / F.when(F.col("weight_g") > 0, F.col("weight_g")), 2)).otherwise(F.col("price")))


def false_kilos(products: DataFrame, weighed: DataFrame, fractional_baskets: DataFrame) -> DataFrame:
    """Products counted in kilograms that evidence says are pieces become pieces, unless a basket holds a fraction of one."""
    flip = products.filter("unit = 'kg'").join(weighed.filter(~F.col("weighed")), "product_id", "left_semi").join(fractional_baskets.select("product_id"), "product_id", "left_anti").select("product_id", F.lit(True).alias("flip"))
    return products.join(flip, "product_id", "left").withColumn("unit", F.when(F.col("flip"), "pcs").otherwise(F.col("unit"))).drop("flip")
