"""Joins against a plain nested-loop reading of the same rows."""

from __future__ import annotations

import bisect
from collections import defaultdict

import pytest
from paths import SMALL
from oracle import spark_rows
from pyspark.sql import Window
from pyspark.sql import functions as F
from skew import skewed_events

from millrace.operators import setops
from millrace.operators.hot import hot_keys, spread_join
from millrace.operators.joins import as_of_join, full_outer, interval_join

MINUTE = 60_000_000


@pytest.fixture(scope="module")
def events(spark):
    return skewed_events(spark, SMALL).cache()


def test_hot_keys_are_few_and_include_null(events):
    found = hot_keys(events, ["user_id"], parts=10, min_rows=10)
    assert [row.user_id for row in found.orderBy("user_id").collect()] == [None, 7]
    assert hot_keys(events, ["event_id"], parts=10, min_rows=10) is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(events, how):
    sides = events.where("user_id % 2 = 1").groupBy("user_id").agg(F.count("*").alias("n"))
    found = spread_join(events, sides, ["user_id"], how, ["event_id"], parts=20, min_rows=10)
    assert spark_rows(found) == spark_rows(events.join(sides, "user_id", how))


def test_spread_join_with_nulls_matching(events):
    sides = events.groupBy("user_id").agg(F.count("*").alias("n"))
    found = spread_join(
        events, sides, ["user_id"], "left", ["event_id"], 20, min_rows=10, nulls_match=True
    )
    expected = events.withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    assert spark_rows(found) == spark_rows(expected)


@pytest.mark.parametrize("most", [7, 1_000_000])
def test_set_operations_keep_duplicates(events, most, monkeypatch):
    monkeypatch.setattr(setops._copies, "__defaults__", (most,))
    left = events.select("user_id", "event_type")
    right = events.where("event_id % 4 <> 0").select("user_id", "event_type")
    for found, expected in (
        (setops.intersect_all(left, right), left.intersectAll(right)),
        (setops.except_all(left, right), left.exceptAll(right)),
        (setops.except_all(right, left), right.exceptAll(left)),
    ):
        assert spark_rows(found) == spark_rows(expected)


def test_full_outer(events):
    left = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("l"))
    right = events.where("event_type = 'view' and (user_id = 7 or user_id > 50)")
    right = right.select("user_id", F.col("event_id").alias("r"))
    found = full_outer(left, right, ["user_id"], ["l"], ["r"])
    assert spark_rows(found) == spark_rows(left.join(right, "user_id", "full"))


@pytest.mark.parametrize("before,after", [(0, 0), (30 * MINUTE, 0), (10 * MINUTE, 50 * MINUTE)])
def test_interval_join(events, before, after):
    left = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("l"), F.col("at").alias("l_at")
    )
    right = events.where("event_type = 'view'").select(
        "user_id", F.col("event_id").alias("r"), F.col("at").alias("r_at")
    )
    found = interval_join(left, right, ["user_id"], "l_at", "r_at", before, after)
    by_user = defaultdict(list)
    for row in right.collect():
        by_user[row.user_id].append((row.r_at, row.r))
    expected = [
        (row.l, r)
        for row in left.collect()
        if row.user_id is not None
        for at, r in by_user[row.user_id]
        if row.l_at - before <= at <= row.l_at + after
    ]
    assert expected
    assert sorted(tuple(r) for r in found.select("l", "r").collect()) == sorted(expected)


@pytest.mark.parametrize("parts", [8, 40])
def test_as_of_join(events, parts):
    left = events.where("event_type = 'purchase'").select("user_id", "event_id", "at")
    right = events.where("event_type = 'view'").select(
        "user_id", "at", F.col("event_id").alias("view_id"), F.col("cents").alias("view_cents")
    )
    found = as_of_join(
        left,
        right,
        ["user_id"],
        "at",
        "view_id",
        ["view_id", "view_cents"],
        ["event_id"],
        parts=parts,
        min_rows=10,
    )
    lines = defaultdict(list)
    for row in right.where("user_id is not null").collect():
        lines[row.user_id].append((row.at, row.view_id, row.view_cents))
    for line in lines.values():
        line.sort()
    expected = {}
    for row in left.collect():
        line = lines[row.user_id]
        place = bisect.bisect_right(line, (row.at, float("inf"), 0))
        expected[row.event_id] = line[place - 1][1:] if place else (None, None)
    actual = {r.event_id: (r.view_id, r.view_cents) for r in found.collect()}
    assert actual == expected
    assert found.count() == len(expected)
    assert any(value[0] is None for value in expected.values())
