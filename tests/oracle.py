"""Compares a query with its SQL as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import decimal
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6))
    return str(v)


def check(spark, name, query, sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names), name
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == want, name
