"""The Python functions and small helpers on edge cases, and the sketches' error."""

from __future__ import annotations

from decimal import Decimal
from types import SimpleNamespace

import pytest
from paths import MEDIUM
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.money import exact_sum
from millrace.functions.times import micros
from millrace.functions.vectorized import WordsWithPlaces, longest_run
from millrace.plans import all_queries
from millrace.sources import scratch_path

FEW = settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_longest_run(spark):
    arrays = [[1.0, 2.0, -1.0], [], None, [-1.0, -2.0, -3.0], [0.0], [1.0, -1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<float>")
    found = df.coalesce(1).select("i", longest_run("a").alias("n")).orderBy("i").collect()
    assert [row.n for row in found] == [2, 0, None, 3, 1, 2]


def test_words_with_places(spark):
    texts = [(1, "one two"), (2, None), (3, ""), (4, "three")]
    df = spark.createDataFrame(texts, "i bigint, t string").coalesce(1)
    rows = [tuple(r) for r in WordsWithPlaces(df.asTable()).collect() if r.word]
    assert sorted(rows) == [(1, 1, "one"), (1, 2, "two"), (4, 1, "three")]


@FEW
@given(st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=30))
def test_exact_sum(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert df.agg(exact_sum(F.col("v"))).first()[0] == Decimal(sum(values))


def test_exact_sum_outgrows_a_long(spark):
    rows = spark.range(4).select(F.lit(2**62).alias("v"))
    assert rows.agg(exact_sum(F.col("v"))).first()[0] == Decimal(2**64)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_micros_does_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stamps = ["2024-03-10 02:30:00.123456", "1969-12-31 23:59:59.999999", "2024-01-01 00:00:00"]
        df = spark.createDataFrame([(s,) for s in stamps], "s string")
        df = df.select(F.col("s").cast("timestamp_ntz").alias("t"))
        found = {row[0] for row in df.select(micros(df, "t")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == {1_710_037_800_123_456, -1, 1_704_067_200_000_000}


def test_sketches_keep_their_error_bound(spark):
    query = next(q for q in all_queries() if q.name == "approximate_distinct_counts")
    for row in query.build(spark, MEDIUM).collect():
        assert row.sketch_within_5_percent and row.direct_within_10_percent


def test_scratch_space_must_be_named(spark):
    class Nameless:
        conf = SimpleNamespace(get=lambda key, default: default)
        sparkContext = SimpleNamespace(getCheckpointDir=lambda: None)

    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    with pytest.raises(ValueError):
        scratch_path(Nameless(), "x")
