from __future__ import annotations

import oracle
import pytest

from basketry import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    oracle.check(spark, name, QUERIES[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
