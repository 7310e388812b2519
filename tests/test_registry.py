"""Every registered analytics query against its DuckDB SQL on the smallest tables."""

import math
import numbers

import duckdb
import pytest

from tracelake.plans import more, registry, runs, traces  # noqa: F401  all fill the registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    return str(float(x)) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_like_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.sql(registry.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())
