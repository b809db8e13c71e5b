"""Joins on keys that a few values may dominate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.prices import WEIGHT_TOLERANCE
from basketry.session import beside, written

#: Rows of one key on one side of a tile, about, and hot keys that are broadcast, at most.
SIDE, MOST_HOT = 1024, 100_000
#: Width of a class of weights: weights that agree are in one class or in neighbouring ones.
WEIGHT_STEP = -math.log(1 - WEIGHT_TOLERANCE) * (1 + 1e-9)


def tiled_join(left: DataFrame, right: DataFrame, keys: list[str], side: int = SIDE, row: str = "id", rows: int = 0) -> DataFrame:
    """Pairs of ``left`` (alias a) and ``right`` (alias b) rows with equal, known keys, each pair once.

    The rows of a key with more than ``side`` rows on either side are dealt, by a hash of ``row``, to the parts of a grid; each
    row goes to the tiles of its part. So a tile has about ``side`` rows of a side, whatever the key's share is. ``rows``: how many
    the smaller side has, about; many are never broadcast.
    """
    n = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c)) for df, c in ((left, "_na"), (right, "_nb"))]
    hot = written(n[0].join(n[1], keys).filter((F.col("_na") > side) | (F.col("_nb") > side)), "hot-keys")
    small = hot.count() <= MOST_HOT
    parts = lambda c: F.coalesce(F.ceil(F.col(c) / side), F.lit(1)).cast("int")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        marked = df.join(F.broadcast(hot) if small else hot, keys, "left").withColumn(f"_{own}", F.pmod(F.xxhash64(row), parts(f"_n{own}")).cast("int"))
        return marked.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), parts(f"_n{other}") - 1))).drop("_na", "_nb")

    a, b = dealt(left, "a", "b").alias("a"), beside(dealt(right, "b", "a").alias("b"), rows)
    return a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_a", "_b"]])


def weight_class(weight: str):
    """The class of a weight; unknown for an unknown one."""
    w = F.col(weight)
    return F.when(w > 0, F.floor(F.log(w) / WEIGHT_STEP).cast("int")).when(w <= 0, F.lit(-(1 << 20)))
