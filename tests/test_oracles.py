"""Every registered query against its SQL in another engine, on the same files."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tessera.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def order(row):
    return tuple((v is None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=order)
    res = duck.sql(registry.oracle_sql()[name])
    assert sorted(res.columns) == cols
    at = [res.columns.index(c) for c in cols]
    theirs = sorted(([plain(r[i]) for i in at] for r in res.fetchall()), key=order)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 * max(1, abs(x)), (a, b)
