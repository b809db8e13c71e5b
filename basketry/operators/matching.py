"""A person's products against a shop's search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions import conflicts as c
from basketry.functions import text as t
from basketry.functions.prices import weight_ok
from basketry.functions.similarity import connector_similarity, ratio_bound, similarity
from basketry.operators.market import every_pair

AUTO, DOUBTFUL, WORTH, CONFIDENT, BRANDED, HELD = 0.75, 0.75, 0.5, 0.75, 0.65, 0.95


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs (name, barcode, weight_g, other, other_barcode, other_weight_g) with ``score``: a barcode decides, a conflict is 0."""
    name, other = F.col("name"), F.col("other")
    clash = c.type_conflict(name, other) | c.brand_conflict(name, other) | c.percent_conflict(name, other)
    coded = F.col("barcode").isNotNull() & F.col("other_barcode").isNotNull()
    alike = F.when(weight_ok(F.col("weight_g"), F.col("other_weight_g")), F.col("alike")).otherwise(F.col("alike") * 0.5)
    score = F.when(coded, (F.col("barcode") == F.col("other_barcode")).cast("double")).when(F.col("clash"), 0.0).otherwise(alike)
    return pairs.withColumn("alike", similarity(name, other)).withColumn("clash", clash).withColumn("score", score).drop("alike", "clash")


def candidates(pairs: DataFrame, most: int = 3) -> DataFrame:
    """The best pairs of each product and shop."""
    w = Window.partitionBy("product_id", "store").orderBy(F.desc("score"), "sku")
    return scored(pairs).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def auto_match(pairs: DataFrame, mapped: DataFrame, rejects: DataFrame) -> DataFrame:
    """The best candidate of products without a mapping, if good enough and not rejected before."""
    free = pairs.join(mapped.select("product_id", "store"), ["product_id", "store"], "left_anti").join(rejects.select("product_id", "store", "sku"), ["product_id", "store", "sku"], "left_anti")
    return candidates(free, 1).filter(F.col("score") >= AUTO)


def doubts_report(mappings: DataFrame) -> DataFrame:
    """Mappings (name, weight_g, other, other_weight_g, from_base) with objections or little likeness; the base's own are skipped."""
    m = mappings.filter(~F.col("from_base")).withColumn("doubts", c.doubts(F.col("name"), F.col("weight_g"), F.col("other"), F.col("other_weight_g")))
    m = m.withColumn("score", similarity(F.col("name"), F.col("other")))
    return m.filter((F.size("doubts") > 0) | (F.col("score") < DOUBTFUL))


def worth(confirmed: Column, score: Column) -> Column:
    """A confirmed candidate, one of unknown likeness, or one that is alike enough."""
    return confirmed | (score <= 0) | (score >= WORTH)


def find_in_chain(asked: DataFrame, found: DataFrame) -> DataFrame:
    """asked: id, name, pack_g; found: id, sku, other, other_pack_g, price, score. One row an id: ok, sku, confidence, difference, reason.

    Reasons: found, alike (brand and pack agree under another name), other (another line or pack), none.
    """
    j = asked.join(found, "id", "left").withColumn("other_pack_g", F.coalesce("other_pack_g", t.weight_g(F.col("other"))))
    fits = c.pack_fits(F.col("pack_g"), F.col("other_pack_g"))
    percent = t.percents_agree(t.parse_percent(F.col("name")), t.parse_percent(F.col("other")))
    j = j.withColumns({"fits": fits, "percent": percent, "brand": F.arrays_overlap(c.brands(F.col("name")), c.brands(F.col("other"))), "difference": c.difference(F.col("name"), F.col("other"), F.col("pack_g"), F.col("other_pack_g"))})
    base = F.coalesce("score", F.lit(0.0))
    raised = F.when(F.col("fits") & F.col("percent"), F.least(F.lit(1.0), base + 0.05)).when((~F.col("fits")) | ~F.col("percent"), F.least(base, F.lit(0.4))).otherwise(base)
    same = (F.col("difference") == "") & F.col("brand") & F.coalesce("fits", F.lit(True)) & F.col("percent")
    sure = F.when(same, F.greatest(raised, F.when(F.col("fits"), 0.85).otherwise(0.75))).otherwise(raised)
    j = j.withColumn("confidence", F.round(F.coalesce(sure, base), 2))
    exact = F.coalesce((F.col("difference") == "") & ((F.col("confidence") >= CONFIDENT) | ((F.col("confidence") >= BRANDED) & F.col("brand") & F.coalesce("fits", F.lit(True)))), F.lit(False))
    reason = F.when(F.col("sku").isNull(), "none").when(exact, "found").when(F.col("brand") & F.coalesce("fits", F.lit(True)), "alike").otherwise("other")
    order = F.struct(F.col("sku").isNotNull(), F.coalesce(F.col("difference") == "", F.lit(False)), "confidence", F.col("sku"))
    cols = ["sku", "confidence", "difference"]
    best = j.withColumn("ok", exact).withColumn("reason", reason).groupBy("id").agg(F.max_by(F.struct("ok", *cols, "reason"), order).alias("b"))
    return best.select("id", "b.*")


def search_terms(name: Column, pack_g: Column) -> Column:
    """Shorter queries of a name: its first words, brand with percent, brand with pack, brand."""
    short = F.array_join(F.slice(t.ordered_words(name), 1, 3), " ")
    brand = F.try_element_at(c.brands(name), F.lit(1))
    return F.array_distinct(F.array_compact(F.array(F.when(short != F.lower(name), short), F.concat_ws(" ", brand, F.when(brand.isNotNull(), t.parse_percent(name).cast("string"))), F.when(brand.isNotNull() & pack_g.isNotNull(), F.concat_ws(" ", brand, pack_g.cast("long").cast("string"))), brand)))


def fallback_search(asked: DataFrame, prices: DataFrame, most: int, least: float = 0.45) -> DataFrame:
    """The reference rows (sku, name, price) most like each asked name (id, name): a name that holds the asked one scores 0.95 at least.

    The asked names are a set of queries that meets all rows, in tiles by the counts of both, so no pair is missed. Pairs whose
    letters, in any order, cannot reach ``least`` never meet Python. Ties go by sku; a null or empty name finds nothing.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    a = asked.select("id", "name").filter(low("name") != "").distinct()
    p = prices.select("sku", F.col("name").alias("other"), "price").distinct()
    plain = lambda c: F.replace(low(c), F.lit("ё"), F.lit("е"))
    pairs = every_pair(a, p).withColumn("inside", F.contains(plain("other"), plain("name")))
    contained = F.contains(low("name"), low("other")) & (low("other") != "")
    pairs = pairs.filter(F.col("inside") | contained | (ratio_bound(low("name"), low("other")) >= least))
    alike = connector_similarity(F.col("name"), F.col("other"))
    scored_pairs = pairs.withColumn("alike", alike).withColumn("score", F.when(F.col("inside"), F.greatest("alike", F.lit(HELD))).otherwise(F.col("alike"))).drop("alike")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "sku", "other")
    return scored_pairs.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
