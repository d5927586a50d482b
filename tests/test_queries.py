"""Every registered map query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tilespark.plans.queries import ORACLE, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(name, spark, duck):
    ours = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLE[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    by_name = dict(zip(theirs.columns, map(str, theirs.types)))
    assert {f.name: kinds[f.dataType.simpleString()] for f in ours.schema.fields} == by_name
    got = plain(ours.select(*columns).collect())
    assert got == plain(theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(SF)
