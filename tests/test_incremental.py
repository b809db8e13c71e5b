"""Resolution by batches of changes against full runs."""

from __future__ import annotations

import os
import random

from test_tiles import CATALOG, catalogue

from basketry.operators import incremental


def full(spark, table: dict, ids: dict) -> dict:
    rows = [(*r[:7], ids.get(i)) for i, r in table.items()]
    return {r.id: (r.item, r.item_id) for r in incremental.resolve_all(spark.createDataFrame(rows, CATALOG)).items.collect()}


def test_batches_give_what_full_runs_give(spark):
    r = random.Random(11)
    table = {row[0]: row for row in catalogue(1, 80)}
    state = incremental.resolve_all(spark.createDataFrame(list(table.values()), CATALOG))
    moved = 0
    for n in range(int(os.environ.get("TEST_BATCHES", "3"))):
        ids = {x.id: x.item_id for x in state.items.collect()}
        gone = r.sample(sorted(table), 4)
        changed = {i: (i, *row[1:]) for i, row in zip(r.sample(sorted(set(table) - set(gone)), 4), catalogue(100 + n, 4), strict=True)}
        changed |= {row[0]: row for row in catalogue(200 + n, 4, first=r.choice([1000 + 10 * n, -10 - 10 * n]))}
        for i in gone:
            del table[i]
        table |= changed
        state = incremental.resolve_changes(state, spark.createDataFrame(list(changed.values()), CATALOG), spark.createDataFrame([(i,) for i in gone], "id long"))
        want = full(spark, table, {i: k for i, k in ids.items() if i in table})
        got = {x.id: (x.item, x.item_id) for x in state.items.collect()}
        assert got == want, n
        moved += sum(ids.get(i) != k for i, (_, k) in got.items())
    assert moved > 0


def test_an_empty_batch_changes_nothing(spark):
    state = incremental.resolve_all(spark.createDataFrame(catalogue(3, 30), CATALOG))
    after = incremental.resolve_changes(state, spark.createDataFrame([], CATALOG), spark.createDataFrame([], "id long"))
    assert sorted(map(tuple, after.items.collect())) == sorted(map(tuple, state.items.collect()))
