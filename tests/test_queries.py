"""Every query that has SQL against DuckDB, and the entry."""

import duckdb
import pytest

import __spark_entry__
from faultline import bindings

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{AT}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = bindings.QUERIES[name](spark, AT)
    rows = got.collect()
    if name in bindings.ORACLES:
        want = duck.sql(bindings.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(repr(plain(tuple(r[c] for c in want.columns))) for r in rows) == sorted(repr(plain(r)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
