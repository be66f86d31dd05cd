"""Every registered query against independent SQL on the same tables."""

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as contract
from stallkeeper.oracle import all_sql
from stallkeeper.plans.catalog import all_queries

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def sides(request, spark):
    sf_dir = f"{TESTDATA}/{request.param}"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    yield spark, sf_dir, con
    con.close()


def spark_types(df):
    return {name: kind.replace("timestamp_ntz", "timestamp") for name, kind in df.dtypes}


def sql_types(relation):
    names = {"VARCHAR": "string", "BIGINT": "bigint", "TIMESTAMP": "timestamp"}
    return {
        name: names.get(str(kind), str(kind).lower())
        for name, kind in zip(relation.columns, relation.types, strict=True)
    }


def comparable(rows, columns, order):
    picked = [tuple(row[columns.index(c)] for c in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is not None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(sides, name):
    spark, sf_dir, con = sides
    actual = QUERIES[name](spark, sf_dir)
    expected = con.sql(SQL[name])
    assert spark_types(actual) == sql_types(expected)
    order = sorted(actual.columns)
    assert comparable(actual.collect(), actual.columns, order) == comparable(
        expected.fetchall(), expected.columns, order
    )


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


def test_entry_is_the_flagship(spark):
    assert contract.entry(spark).count() == 26
