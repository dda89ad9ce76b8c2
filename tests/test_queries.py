"""Every registered query against its SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_queries import TABLES, rows_of, same
from dqspark.queries import QUERIES as LIBRARY

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["n_name", "n_customers", "debt_rate"]
    rates = [r["debt_rate"] for r in df.collect()]
    assert rates and rates == sorted(rates, reverse=True)


def test_every_query_of_the_library_has_its_sql():
    assert set(LIBRARY) <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, result.fetchall())
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
