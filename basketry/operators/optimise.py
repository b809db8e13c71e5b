"""Splitting baskets over shops. The unit of work is one basket; a cluster takes many at once."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from basketry.functions.prices import delivery, offer_discount
from basketry.operators.market import with_sanity
from basketry.session import by_bucket, written

#: Lines of one basket with a choice of store that every split is tried for, and splits of three or more stores, at most;
#: beyond that a basket is searched from several starts.
EXACT_LINES, EXACT_SPLITS = 22, 4_000_000
#: Splits that are held in memory at once.
BLOCK = 1 << 16
#: Splits of a basket's lines with a choice up to which baskets of equal size are searched together, and splits of them at once.
MOST_TOGETHER, TOGETHER = 1024, 1 << 18
BELOW_MINIMUM = 1e9
SHOP_FIELDS = ["fee", "free_from", "min_order", "penalty", "percent", "cap", "min_check", "cap_used"]


def drop_implausible(lines: DataFrame) -> DataFrame:
    """Line prices without those far from the line's median over shops."""
    return with_sanity(lines, ["basket_id", "product_id"], "value").filter("sane").drop("sane")


def store_totals(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Each basket in each store alone: subtotal, delivery, what is missing, whether the least order is met."""
    n = lines.groupBy("basket_id").agg(F.countDistinct("product_id").alias("n"))
    here = lines.filter(F.col("value").isNotNull() & F.coalesce("in_stock", F.lit(True))).groupBy("basket_id", "store").agg(F.round(F.sum("value"), 2).alias("subtotal"), F.countDistinct("product_id").alias("have"))
    # as many rows as baskets: merged where they lie, never sent to every task
    out = here.join(n.hint("merge"), "basket_id").join(stores, "store")
    fee = delivery(F.col("subtotal"), F.col("fee"), F.col("free_from"))
    return out.select("basket_id", "store", "subtotal", fee.alias("delivery"), F.round(F.col("subtotal") + fee, 2).alias("total"), (F.col("n") - F.col("have")).alias("missing"), (F.col("subtotal") < F.coalesce("min_order", F.lit(0.0))).alias("below_minimum"))


def _cost(subtotal: np.ndarray, s: dict) -> np.ndarray:
    """Kopecks of a store's part of the basket, for an array of subtotals; nothing bought costs nothing."""
    k = lambda c: round(100 * s[c]) if pd.notna(s[c]) else None
    fee, free, least = k("fee") or 0, k("free_from"), k("min_order") or 0
    cost = subtotal + (fee if free is None else np.where(subtotal >= free, 0, fee)) + np.where(subtotal < least, BELOW_MINIMUM, 0)
    if pd.notna(s["percent"]):
        off = subtotal * s["percent"] / 100
        if pd.notna(s["cap"]):
            off = np.minimum(off, max(0, (k("cap") or 0) - (k("cap_used") or 0)))
        cost = cost - np.where(subtotal >= (k("min_check") or 0), np.round(off), 0)
    return np.where(subtotal > 0, cost + (k("penalty") or 0), 0)


def _assign(pay: np.ndarray, choice: np.ndarray, shops: list[dict]) -> tuple[float, np.ndarray]:
    """Least total cost and a store for each line; ``pay`` and ``choice`` are lines x stores in kopecks, inf where unavailable."""
    n, m = pay.shape
    options = [np.flatnonzero(np.isfinite(choice[i])) for i in range(n)]
    free = [i for i in range(n) if len(options[i]) > 1]
    at = np.array([o[0] for o in options])
    base = np.zeros(m)
    for i in range(n):
        if len(options[i]) == 1:
            base[at[i]] += pay[i, at[i]]
    fixed = sum(choice[i, at[i]] - pay[i, at[i]] for i in range(n) if len(options[i]) == 1)
    if len(free) <= EXACT_LINES and (m == 2 or m ** len(free) <= EXACT_SPLITS):
        best, code, n_splits = np.inf, 0, math.prod(len(options[i]) for i in free)
        for lo in range(0, n_splits, BLOCK):
            codes = np.arange(lo, min(lo + BLOCK, n_splits))
            sums, extra = np.repeat(base[:, None], len(codes), 1), np.zeros(len(codes))
            rest = codes
            for i in free:
                rest, digit = np.divmod(rest, len(options[i]))
                for d, j in enumerate(options[i]):
                    here = digit == d
                    sums[j] += np.where(here, pay[i, j], 0)
                    extra += np.where(here, choice[i, j] - pay[i, j], 0)
            cost = sum(_cost(sums[j], shops[j]) for j in range(m)) + extra
            k = int(np.argmin(cost))
            if cost[k] < best:
                best, code = cost[k], lo + k
        for i in free:
            code, d = divmod(code, len(options[i]))
            at[i] = options[i][d]
        return float(best + fixed), at

    def total(a: np.ndarray) -> float:
        sub = np.bincount(a, pay[np.arange(n), a], m)
        return float(sum(_cost(np.array([sub[j]]), shops[j])[0] for j in range(m)) + (choice[np.arange(n), a] - pay[np.arange(n), a]).sum())

    starts = [np.array([o[np.argmin(choice[i, o])] for i, o in enumerate(options)])] + [np.array([j if j in o else o[np.argmin(choice[i, o])] for i, o in enumerate(options)]) for j in range(m)]
    best, kept = np.inf, at
    for a in starts:
        now, better = total(a), True
        while better:
            better = False
            for i in free:
                for j in options[i]:
                    if j != a[i]:
                        b = a.copy()
                        b[i] = j
                        if (c := total(b)) < now - 1e-9:
                            a, now, better = b, c, True
        if now < best:
            best, kept = now, a
    return best, kept


def _best_splits(pay: np.ndarray, choice: np.ndarray, shops: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of each basket and a store for each of its lines; ``pay`` and ``choice`` are baskets x lines x stores in
    kopecks, inf where unavailable. Every split of every basket's lines with a choice is tried; lines that no store has cost nothing."""
    m, ok = pay.shape[2], np.isfinite(choice)
    at, options = ok.argmax(2), ok.sum(2)
    paid, more = np.where(ok, pay, 0), np.where(ok, choice, 0) - np.where(ok, pay, 0)
    # lines of one store go there; only those with a choice make splits, and few lines have one
    alone, free = options[:, :, None] == 1, options > 1
    base, extra = np.where(alone, paid, 0).sum(1), np.where(alone, more, 0).sum((1, 2))
    best, counts = np.zeros(len(pay)), free.sum(1)
    for k in np.unique(counts).tolist():
        own = np.flatnonzero(counts == k)
        lines = np.nonzero(free[own])[1].reshape(len(own), k)
        digits = (np.arange(m**k) // m ** np.arange(k)[:, None]) % m
        cost, wrong = np.repeat(extra[own][:, None], m**k, 1), np.zeros((len(own), m**k))
        for j in range(m):
            here = (digits == j).astype(float)
            cost += _cost(base[own, j][:, None] + paid[own[:, None], lines, j] @ here, shops[j]) + more[own[:, None], lines, j] @ here
            wrong += (~ok[own[:, None], lines, j]).astype(float) @ here
        cost[wrong > 0] = np.inf
        code = cost.argmin(1)
        best[own] = cost[np.arange(len(own)), code]
        at[own[:, None], lines] = digits[:, code].T
    return best, at


def split_baskets(lines: DataFrame, stores: DataFrame, most_stores: int = 2, keep: int = 3) -> DataFrame:
    """The best variants of every basket: rank, stores, missing lines, cost (kopecks, with penalties), exact, lines by store.

    ``lines``: basket_id, product_id, store, value, adjust, in_stock; ``stores``: store and SHOP_FIELDS. Stores are
    searched in full up to EXACT_LINES lines with a choice, three or more also up to EXACT_SPLITS splits; ``exact`` is
    false for a basket some of whose stores were not. Variants that use the same stores count once. Baskets of equal size
    with equally few lines that have a choice are searched together.
    """
    schema = "basket_id long, rank int, stores array<string>, missing int, cost long, exact boolean, assigned array<struct<product_id:long,store:string>>"
    names = StructType.fromDDL(schema).names

    def alone(pay: np.ndarray, choice: np.ndarray, info: list[dict]) -> tuple[dict, bool]:
        found, exact = {}, True
        for m in range(1, most_stores + 1):
            for c in combinations(range(len(info)), m):
                have = np.flatnonzero(np.isfinite(choice[:, c]).any(1))
                if len(have):
                    cost, at = _assign(pay[np.ix_(have, c)], choice[np.ix_(have, c)], [info[j] for j in c])
                    free = int((np.isfinite(choice[np.ix_(have, c)]).sum(1) > 1).sum())
                    exact &= free <= EXACT_LINES and (m <= 2 or m**free <= EXACT_SPLITS)
                    add(found, len(pay) - len(have), cost, [(i, c[j]) for i, j in zip(have.tolist(), at.tolist(), strict=True)])
        return found, exact

    def add(found: dict, missing: int, cost: float, at: list[tuple[int, int]]) -> None:
        used = tuple(sorted({j for _, j in at}))
        if used not in found or (missing, cost) < found[used][:2]:
            found[used] = (missing, cost, at)

    def together(pay: np.ndarray, choice: np.ndarray, info: list[dict]) -> list[tuple[dict, bool]]:
        parts, sets = [], {}
        for m in range(1, most_stores + 1):
            for c in combinations(range(len(info)), m):
                p, q = pay[:, :, c], choice[:, :, c]
                have = np.isfinite(q).any(2)
                some = np.flatnonzero(have.any(1))
                if len(some):
                    cost, at = _best_splits(p[some], q[some], [info[j] for j in c])
                    bits = sum(((at == d) & have[some]).any(1).astype(int) << d for d in range(m))
                    used = np.array([sets.setdefault(tuple(c[d] for d in range(m) if x >> d & 1), len(sets)) for x in range(1 << m)])[bits]
                    parts.append((some, (~have[some]).sum(1), cost, used, np.full(len(some), len(parts)), np.arange(len(some)), at, have[some], c))
        out: list[tuple[dict, bool]] = [({}, True) for _ in pay]
        if not parts:
            return out
        basket, missing, cost, used, part, row = (np.concatenate([x[i] for x in parts]) for i in range(6))
        sets_in_order = sorted(sets)
        place = np.empty(len(sets), int)
        place[[sets[u] for u in sets_in_order]] = np.arange(len(sets))
        # of variants of the same stores the best, the first of equal ones; of those the best of each basket
        o = np.lexsort((np.arange(len(cost)), cost, missing, used, basket))
        o = o[np.r_[True, (basket[o][1:] != basket[o][:-1]) | (used[o][1:] != used[o][:-1])]]
        o = o[np.lexsort((place[used[o]], cost[o], missing[o], basket[o]))]
        first = np.flatnonzero(np.r_[True, basket[o][1:] != basket[o][:-1]])
        o = o[np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)])) < keep]
        for i in o.tolist():
            *_, at, here, c = parts[part[i]]
            own = [(x, c[j]) for x, (j, h) in enumerate(zip(at[row[i]].tolist(), here[row[i]].tolist(), strict=True)) if h]
            out[basket[i]][0][sets_in_order[place[used[i]]]] = (int(missing[i]), float(cost[i]), own)
        return out

    def run(b: pd.DataFrame) -> pd.DataFrame:
        shops, at_shop = np.unique(b["store"].to_numpy(str), return_inverse=True)
        first = b.drop_duplicates("store").set_index("store")[SHOP_FIELDS].to_dict("index")
        info = [first[s] for s in shops]
        rows = b[["basket_id", "product_id"]].drop_duplicates().sort_values(["basket_id", "product_id"], ignore_index=True)
        at_line = b.merge(rows.assign(line=rows.index), on=["basket_id", "product_id"], how="left")["line"].to_numpy()
        pay, choice = np.full((len(rows), len(shops)), np.inf), np.full((len(rows), len(shops)), np.inf)
        ok = b["value"].notna().to_numpy() & (b["in_stock"].isna() | b["in_stock"].eq(True)).to_numpy()
        pay[at_line[ok], at_shop[ok]] = np.round(100 * b["value"].to_numpy(float)[ok])
        choice[at_line[ok], at_shop[ok]] = np.round(100 * (b["value"].to_numpy(float) + b["adjust"].fillna(0).to_numpy(float))[ok])
        ids, starts, sizes = np.unique(rows["basket_id"].to_numpy(), return_index=True, return_counts=True)
        solved: list[tuple[dict, bool] | None] = [None] * len(ids)
        with_choice = np.add.reduceat((np.isfinite(choice).sum(1) > 1).astype(int), starts)
        for size, n in np.unique(np.c_[sizes, with_choice], axis=0).tolist():
            own, splits = np.flatnonzero((sizes == size) & (with_choice == n)), most_stores**n
            step = max(1, TOGETHER // splits)
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                cells = starts[some][:, None] + np.arange(size)
                if splits <= MOST_TOGETHER:
                    found = together(pay[cells], choice[cells], info)
                else:
                    found = [alone(pay[x], choice[x], info) for x in cells]
                for i, f in zip(some.tolist(), found, strict=True):
                    solved[i] = f
        product = rows["product_id"].tolist()
        out = []
        for i, (found, exact) in enumerate(solved):
            best = sorted(((r[0], r[1], tuple(shops[j] for j in u), r[2]) for u, r in found.items()), key=lambda r: r[:3])[:keep]
            out += [(int(ids[i]), k + 1, list(u), missing, int(round(cost)), exact, [(product[starts[i] + x], str(shops[j])) for x, j in at]) for k, (missing, cost, u, at) in enumerate(best)]
        return pd.DataFrame(out, columns=names)

    code = F.col("store").cast("string").alias("store")
    joined = lines.select("basket_id", "product_id", code, "value", "adjust", "in_stock").join(stores.select(code, *SHOP_FIELDS), "store")
    return by_bucket(written(joined, "split-lines"), "basket_id", run, schema)  # counted and read


def share_discount(lines: DataFrame, discount: str = "discount") -> DataFrame:
    """A store's discount over its lines by price, in whole kopecks; the rounding residue goes to the last line (``position``).

    Prices and shares are counted in kopecks, so the order of a sum changes nothing; half a kopeck goes to the even one.
    """
    g = Window.partitionBy("basket_id", "store")
    kopecks, all_off = F.round(F.col("value") * 100).cast("long"), F.round(F.col(discount) * 100)
    out = lines.withColumn("_share", F.coalesce(F.bround(F.try_divide(all_off * kopecks, F.sum(kopecks).over(g))).cast("long"), F.lit(0)))
    last = F.col("position") == F.max("position").over(g)
    rest = F.when(last, all_off.cast("long") - F.sum("_share").over(g)).otherwise(0)
    return out.withColumn("share", (F.col("_share") + rest) / 100).drop("_share")


def baseline(lines: DataFrame) -> DataFrame:
    """What a line usually costs: the last receipt, else the base store, else the sane minimum over shops."""
    from basketry.functions.prices import sane_min

    g = lines.groupBy("basket_id", "product_id").agg(F.max("receipt_price").alias("receipt"), F.max(F.when(F.col("is_base"), F.col("value"))).alias("base"), F.collect_list("value").alias("all"))
    return g.select("basket_id", "product_id", F.coalesce("receipt", "base", sane_min(F.col("all"))).alias("baseline"))


def network_overlay(places: DataFrame, quotes: DataFrame, fresh: Column) -> DataFrame:
    """A place's total is the chain's own where it quoted this very basket, completely and lately, less cashback."""
    q = quotes.filter(fresh & F.col("complete")).select("basket_id", "store", "stamp", F.col("total").alias("network"))
    out = places.join(q, ["basket_id", "store", "stamp"], "left")
    own = F.round(F.col("network") - F.coalesce("discount", F.lit(0.0)), 2)
    return out.withColumn("source", F.when(F.col("network").isNotNull(), "network").otherwise("shelf")).withColumn("total", F.coalesce(own, "total")).drop("network")


def promo_stages(parts: DataFrame) -> DataFrame:
    """Promo first, then loyalty bonus up to a share of the rest, then cashback on what is paid, service fee added."""
    rest = F.greatest(F.lit(0.0), F.col("subtotal") - F.coalesce("promo", F.lit(0.0)))
    bonus = F.least(F.coalesce("bonus", F.lit(0.0)), rest * F.coalesce("bonus_pct", F.lit(0.0)) / 100)
    paid = rest - bonus
    back = offer_discount(paid, F.col("percent"), F.col("cap"), F.col("min_check"), F.col("cap_used"))
    return parts.withColumns({"bonus_used": F.round(bonus, 2), "cashback": F.coalesce(back, F.lit(0.0)), "payable": F.round(paid + F.coalesce("service_fee", F.lit(0.0)), 2)})


def split_advised(best_split: Column, split_missing: Column, best_single: Column, single_missing: Column, gain: float = 250.0) -> Column:
    """A split is worth it if one shop lacks more, or if it saves enough."""
    return (split_missing < single_missing) | ((split_missing == single_missing) & (best_single - best_split >= gain))
