"""Every query with an SQL text against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return check.connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert check.rows_of(df.columns, got) == check.rows_of(list(rel.columns), rel.fetchall())


def test_entry(spark, data):
    assert entry.entry(spark).count() == 5
