"""What receipts tell about a shopper. History rows: shopper, product, day, qty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orderable(history: DataFrame, blocked_shops: DataFrame, service: Column) -> DataFrame:
    """Rows of shops that take orders (or of no shop), without services."""
    return history.join(blocked_shops.select("shop"), "shop", "left_anti").filter(~service)


def last_purchase(history: DataFrame) -> DataFrame:
    """What the last day bought, quantities summed."""
    last = history.groupBy("shopper").agg(F.max("day").alias("day"))
    return history.join(last, ["shopper", "day"]).groupBy("shopper", "product").agg(F.sum("qty").alias("qty"))


def month_average(history: DataFrame) -> DataFrame:
    """Quantity a month, over the months in which the shopper bought anything."""
    months = history.groupBy("shopper").agg(F.countDistinct(F.date_format("day", "yyyy-MM")).alias("months"))
    total = history.groupBy("shopper", "product").agg(F.sum("qty").alias("total"))
    return total.join(months, "shopper").select("shopper", "product", F.round(F.col("total") / F.col("months"), 3).alias("qty"))


def habits(history: DataFrame, today: Column) -> DataFrame:
    """Per shopper and product: days bought, median quantity, mean gap in days (null for one day), days since."""
    daily = history.groupBy("shopper", "product", "day").agg(F.sum("qty").alias("qty"))
    h = daily.groupBy("shopper", "product").agg(F.count("day").alias("times"), F.median("qty").alias("qty"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    gap = F.when(F.col("times") > 1, F.round(F.datediff("last_day", "first_day") / (F.col("times") - 1), 1))
    return h.withColumn("cycle", gap).withColumn("since", F.datediff(today, "last_day"))


def due(habit: DataFrame) -> DataFrame:
    return habit.filter(F.col("cycle").isNotNull() & (F.col("since") >= F.col("cycle")))


def usual(habit: DataFrame, least: int = 3) -> DataFrame:
    return habit.filter(F.col("times") >= least)


def regular(history: DataFrame, least: int) -> DataFrame:
    return history.groupBy("shopper", "product").agg(F.countDistinct("day").alias("days")).filter(F.col("days") >= least)


def missing_regulars(regulars: DataFrame, basket: DataFrame) -> DataFrame:
    return regulars.join(basket.select("shopper", "product"), ["shopper", "product"], "left_anti")


def basket_from_history(history: DataFrame, kind: str, today: Column) -> DataFrame:
    """A basket by recipe: last, month or usual."""
    if kind == "last":
        return last_purchase(history)
    if kind == "month":
        return month_average(history)
    if kind == "usual":
        return usual(habits(history, today)).select("shopper", "product", "qty")
    raise ValueError(kind)


def set_quantities(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Basket lines with changes applied: pieces are whole, nothing left means no line."""
    from basketry.functions.prices import whole_pieces

    c = changes.select("basket_id", "product_id", F.col("qty").alias("new_qty"), F.col("unit").alias("new_unit"))
    both = items.join(c, ["basket_id", "product_id"], "full_outer")
    qty, unit = F.coalesce("new_qty", "qty"), F.coalesce("new_unit", "unit")
    return both.select("basket_id", "product_id", unit.alias("unit"), F.when((unit == "pcs") & (qty > 0), whole_pieces(qty)).otherwise(qty).alias("qty")).filter("qty > 0")
