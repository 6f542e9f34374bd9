"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyhouse import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return con


def shown(value):
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{value.normalize() + 0:f}"
    if isinstance(value, (list, tuple)):
        return str([shown(v) for v in value])
    if isinstance(value, dict):
        return str({k: shown(v) for k, v in sorted(value.items())})
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_rows_match_the_sql(spark, tables, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([shown(r[c]) for c in columns] for r in (r.asDict(recursive=True) for r in df.collect()))
    found = tables.execute(own.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted([shown(dict(zip(names, r))[c]) for c in sorted(names)] for r in found.fetchall())
    assert columns == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert own.queries()[name](spark, SF).count() > 0


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
