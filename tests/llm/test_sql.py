"""The training-text queries that SQL can express, against that SQL on whole tables."""

from __future__ import annotations

import pytest
from oracle import connect, duck_rows, spark_rows
from paths import MEDIUM

from millrace.llm.queries import llm_queries

QUERIES = {query.name: query for query in llm_queries() if query.oracle}


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, name):
    result = QUERIES[name].build(spark, MEDIUM)
    with connect(MEDIUM) as duck:
        columns, expected = duck_rows(duck, QUERIES[name].oracle)
    assert sorted(result.columns) == sorted(columns)
    actual = spark_rows(result)
    assert len(actual) == len(expected)
    assert actual == expected
