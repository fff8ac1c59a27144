"""Every registered query beside its SQL on the smallest supplied tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def test_sql_belongs_to_registered_queries():
    assert SQL.keys() <= QUERIES.keys()


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, key):
    assert check.compare(spark, con, SF_DIR, key, QUERIES[key], SQL.get(key))
