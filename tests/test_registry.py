"""Every query of the core against its SQL, on the smallest data set. Those of the optional part
are tested with it."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points
from tillstream.plans import oracle, registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES = registry.all_queries()
SQL = oracle.all_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if isinstance(value, Decimal) else value


def by_column_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (sorted(columns),
            sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, SF)
    expected = duck.execute(SQL[name])
    columns = [column[0] for column in expected.description]
    assert by_column_name(result.columns, result.collect()) == by_column_name(
        columns, expected.fetchall())


def test_entry_points_hold_every_query():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
