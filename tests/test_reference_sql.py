"""Every named query against the same question asked in SQL of a second engine."""

import pytest

import __spark_entry__ as entry
import compare
from conftest import SMALL
from gridcompare.plans.catalog import all_queries
from gridcompare.plans.reference_sql import all_reference_sql

QUERIES, SQL = all_queries(), all_reference_sql()


@pytest.fixture(scope="module")
def duck():
    with compare.connect(SMALL) as con:
        yield con


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, duck, small_dir):
    columns, rows = compare.spark_rows(QUERIES[name](spark, small_dir))
    expected_columns, expected = compare.duck_rows(duck, SQL[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows, "a query that returns nothing proves nothing"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
