"""The operators' queries against their SQL, and against what the contract fixes."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    res = c.sql(queries.oracle_sql()[name])
    assert sorted(res.columns) == cols
    at = [res.columns.index(x) for x in cols]
    mine = sorted(tuple(r[x] for x in cols) for r in df.collect())
    assert mine == sorted(tuple(r[i] for i in at) for r in res.fetchall()) and mine
