"""Percentiles, grouping sets and time windows against Spark's plain forms or plain Python."""

from __future__ import annotations

from collections import defaultdict

import pytest
from paths import SMALL
from oracle import spark_rows
from pyspark.sql import Window
from pyspark.sql import functions as F
from skew import skewed_events

from millrace.operators.grouping import grouping_totals, pivot_sums
from millrace.operators.percentiles import exact_percentiles
from millrace.operators.timewindows import sessions, sliding_sums, trailing_sums
from millrace.sources.tables import scratch_path

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def events(spark):
    target = scratch_path(spark, "skewed")
    skewed_events(spark, SMALL).write.parquet(target)
    return spark.read.parquet(target)


@pytest.mark.parametrize("parts", [8, 50])
@pytest.mark.parametrize("value", ["cents", "at"])
@pytest.mark.parametrize("keys", [[], ["user_id"], ["event_type"]])
def test_exact_percentiles(events, keys, value, parts):
    shares = {"lowest": 0.0, "p10": 0.1, "half": 0.5, "p99": 0.99, "highest": 1.0}
    found = exact_percentiles(events, keys, value, shares, ["event_id"], parts, min_rows=10)
    wanted = [F.percentile(value, share).alias(name) for name, share in shares.items()]
    expected = events.groupBy(*keys).agg(*wanted)

    # Spark weighs the two neighbours in another order, which shows in the last bits.
    def by_key(df):
        rows = df.select(*keys, *[F.col(name).cast("double") for name in shares]).collect()
        return {repr(row[: len(keys)]): pytest.approx(list(row[len(keys) :]), rel=1e-12) for row in rows}

    actual = {repr(row[: len(keys)]): list(row[len(keys) :]) for row in found.select(*keys, *shares).collect()}
    assert actual == by_key(expected)


@pytest.mark.parametrize(
    "sets,sql",
    [
        ("rollup", "ROLLUP(event_type, user_id)"),
        ("cube", "CUBE(event_type, user_id)"),
        ([["event_type"], ["user_id"], []], "GROUPING SETS ((event_type), (user_id), ())"),
    ],
)
def test_grouping_totals(spark, events, sets, sql):
    events.createOrReplaceTempView("skewed")
    found = grouping_totals(
        events,
        ["event_type", "user_id"],
        sets,
        {"n": F.count("*"), "total": F.sum("cents")},
        {"g_type": "event_type", "g_user": "user_id"},
    )
    expected = spark.sql(
        f"""SELECT event_type, user_id, count(*) AS n, sum(cents) AS total,
                   cast(grouping(event_type) AS int) AS g_type,
                   cast(grouping(user_id) AS int) AS g_user
            FROM skewed GROUP BY {sql}"""
    )
    assert spark_rows(found) == spark_rows(expected)


def test_sliding_sums(events):
    sums = {"n": F.lit(1), "total": F.col("cents")}
    found = sliding_sums(events, "ts", "3 hours", "1 hour", ["event_type"], sums)
    expected = (
        events.groupBy(F.window("ts", "3 hours", "1 hour").alias("w"), "event_type")
        .agg(F.sum(F.lit(1)).alias("n"), F.sum("cents").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
    assert spark_rows(found) == spark_rows(expected)


@pytest.mark.parametrize("parts", [8, 50])
@pytest.mark.parametrize("width", [0, HOUR, 50 * HOUR])
def test_trailing_sums(events, width, parts):
    sums = {"n": F.lit(1), "total": F.col("cents")}
    found = trailing_sums(events, ["user_id"], "at", "event_id", width, sums, parts, min_rows=10)
    frame = Window.partitionBy("user_id").orderBy("at").rangeBetween(-width, 0)
    expected = events.withColumns({"n": F.count("*").over(frame), "total": F.sum("cents").over(frame)})
    assert spark_rows(found) == spark_rows(expected)


@pytest.mark.parametrize("parts", [8, 50])
@pytest.mark.parametrize("gap", [0, HOUR, 12 * HOUR])
def test_sessions(events, gap, parts):
    sums = {"n": F.lit(1), "total": F.col("cents")}
    found = sessions(events, ["user_id"], "at", gap, sums, ["event_id"], parts, min_rows=10)
    by_user = defaultdict(list)
    for row in events.collect():
        by_user[row.user_id].append((row.at, row.cents))
    expected = []
    for user, line in by_user.items():
        line.sort()
        current = None
        for at, cents in line:
            if current is None or at - current[2] > gap:
                current = [user, at, at, 0, 0]
                expected.append(current)
            current[2:] = [at, current[3] + 1, current[4] + cents]
    rows = found.select("user_id", "start_at", "end_at", "n", "total").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, map(tuple, expected)))


def test_percentiles_keep_groups_without_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    found = exact_percentiles(rows, ["k"], "v", {"half": 0.5}, ["v"])
    assert {tuple(r) for r in found.collect()} == {("a", 2.0), ("b", None)}


@pytest.mark.parametrize("kind", ["decimal(12,2)", "float", "double"])
def test_percentiles_of_split_groups_by_type(events, kind):
    rows = events.withColumn("v", F.col("cents").cast(kind))
    shares = {"p10": 0.1, "half": 0.5}
    split = exact_percentiles(rows, ["event_type"], "v", shares, ["event_id"], 20, min_rows=10)
    whole = exact_percentiles(rows, ["event_type"], "v", shares, ["event_id"], 20, min_rows=10**9)
    assert spark_rows(split) == spark_rows(whole)


def test_sliding_windows_must_be_made_of_whole_panes(events):
    with pytest.raises(ValueError, match="no whole multiple"):
        sliding_sums(events, "ts", "5 hours", "2 hours", [], {"n": F.lit(1)})


@pytest.mark.parametrize("total", [F.avg, F.min])
def test_grouping_totals_must_add_up(events, total):
    with pytest.raises(ValueError, match="do not add up"):
        grouping_totals(events, ["event_type"], "rollup", {"x": total("cents")})


def test_pivot_keeps_what_is_not_listed(events):
    rows = events.withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "refund").otherwise(F.col("event_type")))
    found = pivot_sums(rows, [], "event_type", ["view"], F.col("cents")).first()
    total = rows.agg(F.sum("cents")).first()[0]
    assert found["other"] and found["view"] + found["other"] == total
