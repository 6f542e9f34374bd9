"""Queries with SQL give the rows that DuckDB gives on the same tables."""

import pytest

from tallyhouse.llm import queries
from tests.test_queries import SF, shown, tables  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_match_the_sql(spark, tables, name):  # noqa: F811
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([shown(r[c]) for c in columns] for r in (r.asDict(recursive=True) for r in df.collect()))
    found = tables.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted([shown(dict(zip(names, r))[c]) for c in sorted(names)] for r in found.fetchall())
    assert columns == sorted(names) and got == want
