"""Every registered query of the core against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from larkspur.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings benchmark conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
