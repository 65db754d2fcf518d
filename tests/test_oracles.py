"""Every registered query of the market against its SQL twin."""

import decimal

import duckdb
import pytest

from lotwise.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(f"{float(r[i]):.6g}" if isinstance(r[i], int) and not isinstance(r[i], bool) else norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())
