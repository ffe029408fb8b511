"""Every registered query against DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, duck_table, spark_table

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    columns, rows = spark_table(QUERIES[name](spark, sf_dir))
    assert columns
    if name not in SQL:
        assert rows
        return
    expected_columns, expected_rows = duck_table(duck, SQL[name])
    assert columns == expected_columns
    assert len(rows) == len(expected_rows)
    assert rows == expected_rows


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["Date", "Sentiment", "chats"]
    assert not frame.isEmpty()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
