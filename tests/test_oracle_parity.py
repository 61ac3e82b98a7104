"""Every registered query equals its DuckDB SQL on sf0.001 (the driver's check
runs the same comparison at sf0.01: ``python tests/oracle_check.py``)."""

import duckdb
import pytest

import __spark_entry__ as E
from flowwatch.sources.tables import TABLES
from flowwatch.plans.catalog import REGISTRY
from oracle_check import _rows

SF = "/root/testdata/sf0.001"
KEYS = sorted(set(E.queries()) & set(E.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_oracle_sql():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(REGISTRY) <= set(E.oracle_sql())      # the library's own operators; learned ones have tests of their own


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "deduplication_key" in df.columns


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.collect(), df.columns) == _rows(res.fetchall(), ocols)
