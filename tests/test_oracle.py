"""Every page query against its SQL, at all three scales."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from pagequarry.plans.catalog import OPERATORS

DUCKDB_TYPES = {"BIGINT": "bigint", "VARCHAR": "string"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_query_matches_sql(spark, folder, name):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    expected = connection.sql(entry_point.oracle_sql()[name])
    actual = entry_point.queries()[name](spark, folder)

    assert dict(actual.dtypes) == {
        column: DUCKDB_TYPES[str(kind)]
        for column, kind in zip(expected.columns, expected.types)
    }
    columns = sorted(actual.columns)
    positions = [expected.columns.index(column) for column in columns]
    expected_rows = [tuple(row[i] for i in positions) for row in expected.fetchall()]
    actual_rows = [tuple(row) for row in actual.select(*columns).collect()]
    assert sorted(actual_rows, key=repr) == sorted(expected_rows, key=repr)
    assert actual_rows


def test_every_query_has_sql():
    sql = entry_point.oracle_sql().keys()
    assert OPERATORS.keys() <= sql <= entry_point.queries().keys()


def test_entry_returns_all_pages(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["page_id", "title", "h1", "lang", "host"]
    assert result.count() == 50
