"""The best of all offers of a store, for any number of totals.

As a total grows an offer gives nothing up to its least check, then its percent, then its cap. Of offers that are not at their
cap the one of the highest percent gives the most; of those at their cap the one of the highest cap. So a total has to
meet two candidates only, and each of them is constant over stretches of totals: the pieces of two upper envelopes.
Envelopes are made per chunk of a store's offers and merged, as a tree of aggregates is, and totals find their pieces by
classes of size.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.prices import offer_discount
from basketry.session import written

#: Offers of a chunk, about, and the ends of the classes of totals: eighths of an octave.
CHUNK, LOWEST, HIGHEST = 20_000, -64, 512
#: Ends of stretches are widened by this share, as the cap is reached at a quotient that is rounded.
SLACK = 1e-9
OFFER = ["offer_id", "percent", "cap", "min_check", "cap_used"]


def envelope(starts: list[float], ends: list[float], ranks: list[tuple]) -> list[tuple[float, float, int]]:
    """Stretches (start, end, index) on which the interval of the highest rank is the given one; none where no interval is."""
    order = sorted(range(len(starts)), key=starts.__getitem__)
    points = sorted({*starts, *ends})
    heap: list[tuple] = []
    found: list[tuple[float, float, int]] = []
    k = 0
    for lo, hi in zip(points, points[1:], strict=False):
        while k < len(order) and starts[order[k]] <= lo:
            i = order[k]
            heapq.heappush(heap, (tuple(-x for x in ranks[i]), i))
            k += 1
        while heap and ends[heap[0][1]] <= lo:
            heapq.heappop(heap)
        if heap:
            i = heap[0][1]
            if found and found[-1][2] == i and found[-1][1] == lo:
                found[-1] = (found[-1][0], hi, i)
            else:
                found.append((lo, hi, i))
    return found


def _pieces(stretches: DataFrame, keys: list[str]) -> DataFrame:
    def run(b: pd.DataFrame) -> pd.DataFrame:
        found = envelope(b["lo"].tolist(), b["hi"].tolist(), list(zip(b["worth"], b["percent"], -b["offer_id"], strict=True)))
        out = b.iloc[[i for _, _, i in found]].copy()
        out["lo"], out["hi"] = [lo for lo, _, _ in found], [hi for _, hi, _ in found]
        return out

    return stretches.groupBy(*keys).applyInPandas(run, stretches.schema)


def pieces(offers: DataFrame) -> DataFrame:
    """store, capped, lo, hi and the offer that counts from ``lo`` up to ``hi``, before and after caps are reached."""
    known = offers.filter("percent > 0").select("store", *[F.col(c) if c == "offer_id" else F.col(c).cast("double") for c in OFFER])
    left = F.col("cap") - F.coalesce(F.col("cap_used"), F.lit(0.0))
    most = F.coalesce(left, F.lit(math.inf))
    least = F.coalesce(F.col("min_check"), F.lit(0.0))
    # of offers that differ in nothing but their identifier the first counts
    known = known.withColumn("left", most).withColumn("least", least).filter("left > 0").groupBy("store", "percent", "left", "least").agg(F.min_by(F.struct("offer_id", "cap", "min_check", "cap_used"), "offer_id").alias("o"))
    known = known.select("store", "percent", "left", "least", "o.*").withColumn("full", F.col("left") * 100 / F.col("percent"))
    rising = known.select("store", F.lit(False).alias("capped"), F.col("least").alias("lo"), (F.col("full") * (1 + SLACK)).alias("hi"), F.lit(0.0).alias("worth"), *OFFER)
    capped = known.filter(F.col("left") < math.inf).select("store", F.lit(True).alias("capped"), F.greatest("least", F.col("full") * (1 - SLACK)).alias("lo"), F.lit(math.inf).alias("hi"), F.round("left", 2).alias("worth"), *OFFER)
    every = written(rising.unionByName(capped).filter("lo < hi"), "offer-stretches")
    chunks = max(1, every.count() // CHUNK)
    parts = _pieces(every.withColumn("chunk", F.pmod(F.xxhash64("store", "offer_id"), F.lit(chunks))), ["store", "capped", "chunk"]).drop("chunk")
    return written(_pieces(parts, ["store", "capped"]), "offer-pieces")


def _size(total: Column) -> Column:
    """The class of a total, from ``LOWEST`` to ``HIGHEST``."""
    return F.when(total > 0, F.least(F.greatest(F.floor(8 * F.log2(total)), F.lit(LOWEST)), F.lit(HIGHEST))).otherwise(F.lit(LOWEST)).cast("int")


def best_offer(totals: DataFrame, offers: DataFrame) -> DataFrame:
    """Totals (key columns, store, total) with the offer that gives the most: then the higher percent, then the lower id.

    Offers (store, offer_id, percent, cap, min_check, cap_used) without a positive percent never count. A total that no offer
    fits, or without a store, has a discount of 0 and no offer. Repeated totals stay.
    """
    found = pieces(offers)
    gives = lambda o: offer_discount(F.col("total"), o["percent"], o["cap"], o["min_check"], o["cap_used"])
    out, best = totals.withColumn("_size", _size(F.col("total"))), []
    # neighbouring classes as well: logarithms are rounded
    sizes = F.explode(F.sequence(F.greatest(_size(F.col("lo")) - 1, F.lit(LOWEST)), F.least(_size(F.col("hi")) + 1, F.lit(HIGHEST))))
    for capped in (False, True):
        name = f"_capped_{capped}"
        own = found.filter(F.col("capped") == capped).select(F.col("store").alias("_s"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), sizes.alias("_z"), F.struct(*OFFER).alias(name))
        fits = (F.col("store") == F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("total") >= F.col("_lo")) & (F.col("total") < F.col("_hi"))
        out = out.join(own, fits, "left").drop("_s", "_lo", "_hi", "_z")
        o = F.col(name)
        best.append(F.when(o.isNotNull(), F.struct(gives(o).alias("discount"), o["percent"].alias("percent"), (-o["offer_id"]).alias("neg_id"))))
    out = out.withColumn("_best", F.array_max(F.array(*best)))
    gain = F.col("_best.discount") > 0
    return out.select(*totals.columns, F.when(gain, F.col("_best.discount")).otherwise(F.lit(0.0)).alias("discount"), F.when(gain, -F.col("_best.neg_id")).alias("offer_id"))
