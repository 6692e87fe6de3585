"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from paths import MEDIUM
from oracle import connect, duck_rows, spark_rows

from millrace.plans import all_queries

SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}
QUERIES = {query.name: query for query in all_queries()}


@pytest.fixture(scope="module")
def duck():
    with connect(MEDIUM) as con:
        yield con


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.oracle])
def test_matches_sql(spark, duck, name):
    query = QUERIES[name]
    result = query.build(spark, MEDIUM)
    columns, expected = duck_rows(duck, query.oracle)
    assert sorted(result.columns) == sorted(columns)
    types = {row[0]: row[1] for row in duck.execute(f"DESCRIBE {query.oracle}").fetchall()}
    assert {name: SAME_TYPE[kind] for name, kind in result.dtypes} == types
    actual = spark_rows(result)
    assert len(actual) == len(expected)
    assert actual == expected


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.oracle])
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name].build(spark, MEDIUM).count() > 0
