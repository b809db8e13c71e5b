"""What the physical plans must not hold."""

from __future__ import annotations

import re

import oracle
import pytest

from basketry import registry

QUERIES = registry.queries()

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product_and_no_row_at_a_time_python(spark, name):
    text = plan(QUERIES[name](spark, oracle.SF))
    assert not any(node in text for node in ("CartesianProduct", "BatchEvalPython", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize(
    "name,columns",
    [
        ("cheapest_offer", {"l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"}),
        ("receipts_by_month", {"o_orderdate", "o_totalprice"}),
        ("token_search", {"p_partkey", "p_name", "p_brand"}),
        ("price_change_log", {"user_id", "event_type", "event_id", "ts", "value"}),
    ],
)
def test_scans_read_only_what_is_asked(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, oracle.SF)))
    assert read and all({c.split(":")[0] for c in r.split(",")} <= columns for r in read)


def test_filters_reach_the_scan(spark):
    assert "GreaterThan(o_totalprice,1000.0)" in plan(QUERIES["shopper_orders"](spark, oracle.SF))
