"""Splits against brute force where no single line pays to move."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from basketry.operators import optimise


def shop(**fields) -> dict:
    return dict.fromkeys(optimise.SHOP_FIELDS) | fields


def brute(pay: np.ndarray, choice: np.ndarray, shops: list[dict]) -> float:
    n, m = pay.shape
    best = np.inf
    for at in product(*[np.flatnonzero(np.isfinite(choice[i])) for i in range(n)]):
        sub = np.bincount(at, pay[np.arange(n), list(at)], m)
        cost = sum(float(optimise._cost(np.array([sub[j]]), shops[j])[0]) for j in range(m))
        best = min(best, cost + float((choice[np.arange(n), list(at)] - pay[np.arange(n), list(at)]).sum()))
    return best


def test_three_stores_are_searched_in_full():
    r, worse = np.random.default_rng(3), 0
    for _ in range(60):
        n, m = int(r.integers(2, 6)), int(r.integers(3, 5))
        pay = r.integers(5_000, 40_000, (n, m)).astype(float)
        pay[r.random((n, m)) < 0.2] = np.inf
        pay[np.arange(n), r.integers(0, m, n)] = 20_000.0
        choice = pay + r.integers(-500, 500, (n, m))
        shops = [shop(fee=float(r.integers(100, 400)), free_from=float(r.integers(300, 900)), min_order=float(r.integers(0, 500)), penalty=float(r.integers(0, 50)), percent=float(r.integers(0, 15)), cap=100.0, min_check=float(r.integers(0, 500)), cap_used=0.0) for _ in range(m)]
        cost, at = optimise._assign(pay, choice, shops)
        assert cost == pytest.approx(brute(pay, choice, shops), abs=1e-3)
        assert np.isfinite(choice[np.arange(n), at]).all()


def test_a_pair_with_twenty_lines_is_searched_in_full(monkeypatch):
    # equal lines, so only how many go to each shop matters; delivery and discounts need many lines at once
    n = 20
    pay = np.tile([10_000.0, 9_500.0], (n, 1))
    shops = [shop(fee=300.0, free_from=1000.0, percent=20.0, cap=100.0, min_check=1000.0), shop(fee=300.0, free_from=800.0, percent=30.0, cap=250.0, min_check=800.0)]
    subs = [np.array([10_000.0 * k]) for k in range(n + 1)]
    want = min(float(optimise._cost(subs[k], shops[0])[0] + optimise._cost(subs[n - k] * 0.95, shops[1])[0]) for k in range(n + 1))
    monkeypatch.setattr(optimise, "BLOCK", 1 << 14, raising=False)  # many blocks
    assert optimise._assign(pay, pay.copy(), shops)[0] == pytest.approx(want)


def test_small_baskets_together_are_as_good_as_brute_force():
    r = np.random.default_rng(8)
    for m in (1, 2, 3):
        pay = r.integers(5_000, 40_000, (40, 4, m)).astype(float)
        pay[r.random(pay.shape) < 0.3] = np.inf
        choice = pay + r.integers(-500, 500, pay.shape)
        shops = [shop(fee=float(r.integers(100, 400)), free_from=float(r.integers(300, 900)), min_order=float(r.integers(0, 500)), penalty=float(r.integers(0, 50)), percent=float(r.integers(0, 15)), cap=100.0, min_check=float(r.integers(0, 500)), cap_used=0.0) for _ in range(m)]
        cost, at = optimise._best_splits(pay, choice, shops)
        for b in range(40):
            have = np.isfinite(choice[b]).any(1)
            assert cost[b] == pytest.approx(brute(pay[b][have], choice[b][have], shops), abs=1e-3)
            assert np.isfinite(choice[b][np.arange(4), at[b]][have]).all()


def test_baskets_of_any_size_in_one_table(spark, monkeypatch):
    """Small baskets together and large ones alone give what each alone gives, and say whether they were searched in full."""
    r = np.random.default_rng(5)
    rows = [(int(b), int(p), str(s), float(v), None, True) for b, n in enumerate([1, 3, 3, 5, 12, 24]) for p in range(n) for s, v in zip("ab", r.integers(50, 400, 2), strict=True)]
    lines = spark.createDataFrame(rows, "basket_id long, product_id long, store string, value double, adjust double, in_stock boolean")
    stores = spark.createDataFrame([("a", 99.0, 800.0, 0.0, 5.0, None, None, 0.0, 0.0), ("b", 149.0, 500.0, 300.0, 9.0, 5.0, 100.0, 500.0, 0.0)], "store string, " + ", ".join(f"{c} double" for c in optimise.SHOP_FIELDS))
    got = {x.basket_id: x for x in optimise.split_baskets(lines, stores, 2, 1).collect()}
    info = [x.asDict() for x in stores.orderBy("store").collect()]
    for b, n in enumerate([1, 3, 3, 5, 12]):
        pay = np.array([[100 * v for i, p, s, v, *_ in rows if i == b and p == k] for k in range(n)])
        assert got[b].cost == round(optimise._assign(pay, pay, info)[0]) and got[b].exact and len(got[b].assigned) == n
    assert not got[5].exact and len(got[5].assigned) == 24
