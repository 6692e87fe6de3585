"""Streams in several batches: late rows, repeats, restarts, and a hot key's state."""

from __future__ import annotations

import uuid

import pytest
from paths import SMALL
from oracle import spark_rows
from pyspark.sql import functions as F

from millrace.functions.money import cents
from millrace.plans.streams import streamed_hours, streamed_hours_in_batches
from millrace.sources import arriving, scratch_path, table
from millrace.streaming.drain import drain
from millrace.streaming.matching import once_each, stream_interval_join
from millrace.streaming.state import largest_of_day
from millrace.streaming.windows import on_event_time, stream_sessions, stream_window_sums

DELAY = "10 minutes"


class Feed:
    """A folder that a stream reads and the test adds to, one file per delivery."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.folder = scratch_path(spark, f"feed-{uuid.uuid4().hex}")

    def deliver(self, df):
        df.coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.folder)


@pytest.fixture
def events(spark):
    rows = table(spark, SMALL, "events").withColumn("cents", cents("value"))
    hot = F.col("event_id") % 3 == 0
    return rows.withColumn("user_id", F.when(hot, F.lit(7)).otherwise(F.col("user_id")))


def test_late_rows_are_left_out_and_a_restart_goes_on(spark, events):
    feed = Feed(spark, events.schema)
    folder = scratch_path(spark, "late")

    def run():
        stream = on_event_time(feed.stream(), "ts", DELAY)
        sums = {"n": F.lit(1)}
        return drain(stream_window_sums(stream, "ts", "1 hour", None, [], sums), "late", folder)

    late = events.where("event_id = 5")
    feed.deliver(events.where("event_id < 400 and event_id <> 5"))
    run()
    feed.deliver(events.where("event_id >= 400"))
    feed.deliver(late)
    found = run()
    upto = events.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    expected = (
        events.where("event_id <> 5")
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"))
        .where(F.col("w.end") <= F.lit(upto))
        .select(F.col("w.start").cast("timestamp").alias("window_start"), "n")
    )
    assert spark_rows(found) == spark_rows(expected)


def test_repeats_across_batches_count_once(spark, events):
    feed = Feed(spark, events.schema)
    folder = scratch_path(spark, "repeats")

    def run():
        return drain(once_each(feed.stream(), ["event_id"], "ts", "60 days"), "repeats", folder)

    feed.deliver(events.where("event_id < 600"))
    run()
    again = events.where("event_id >= 300")
    hot = events.where("event_id = 17").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(500))))
    feed.deliver(again.unionByName(hot.drop("_copy")).unionByName(again))
    found = run()
    assert sorted(r.event_id for r in found.select("event_id").collect()) == sorted(
        r.event_id for r in events.select("event_id").collect()
    )


def test_sessions_grow_across_batches(spark, events):
    feed = Feed(spark, events.schema)
    folder = scratch_path(spark, "grow")

    def run():
        stream = on_event_time(feed.stream(), "ts", DELAY)
        return drain(
            stream_sessions(stream, "ts", "8 hours", ["user_id"], {"n": F.lit(1)}), "grow", folder
        )

    for low, high in ((0, 333), (333, 334), (334, 2000)):
        feed.deliver(events.where(f"event_id >= {low} and event_id < {high}"))
        found = run()
    upto = events.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    # Not filtered in Spark: it would push a filter on the end below the merging of sessions.
    every = (
        events.groupBy(F.session_window("ts", "8 hours").alias("s"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("s.start", "s.end", "user_id", "n")
    )
    expected = {tuple(row) for row in every.collect() if row.end <= upto}
    rows = [tuple(r) for r in found.select("start_at", "end_at", "user_id", "n").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == expected


def test_streams_meet_across_batches(spark, events):
    feed = Feed(spark, events.schema)
    folder = scratch_path(spark, "meet")

    def run():
        stream = on_event_time(feed.stream(), "ts", DELAY)
        left = stream.where("event_type = 'purchase'").select(
            "user_id", F.col("event_id").alias("l"), F.col("ts").alias("l_ts")
        )
        again = on_event_time(feed.stream(), "ts", DELAY)
        right = again.where("event_type = 'view'").select(
            "user_id", F.col("event_id").alias("r"), F.col("ts").alias("r_ts")
        )
        pairs = stream_interval_join(left, right, ["user_id"], "l_ts", "r_ts", 3 * 3600)
        return drain(pairs.select("l", "r"), "meet", folder)

    for low, high in ((0, 500), (500, 501), (501, 2000)):
        feed.deliver(events.where(f"event_id >= {low} and event_id < {high}"))
        found = run()
    rows = events.select("event_id", "user_id", "event_type", "ts").collect()
    views = [r for r in rows if r.event_type == "view"]
    expected = [
        (p.event_id, v.event_id)
        for p in rows
        if p.event_type == "purchase"
        for v in views
        if v.user_id == p.user_id and 0 <= (p.ts - v.ts).total_seconds() <= 3 * 3600
    ]
    assert expected
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_largest_of_day_over_batches_with_a_late_row(spark, events):
    feed = Feed(spark, events.schema)
    folder = scratch_path(spark, "largest")

    def run():
        stream = largest_of_day(feed.stream(), "user_id", "ts", "event_id", "cents", 3, DELAY)
        return drain(stream, "largest", folder)

    late = events.where("event_id = 5").withColumn("cents", F.lit(10**9))
    for low, high in ((0, 5), (6, 250), (250, 600)):
        feed.deliver(events.where(f"event_id >= {low} and event_id < {high}"))
        run()
    feed.deliver(late.unionByName(events.where("event_id >= 600")))
    found = run()
    by_day = {}
    for row in events.where("event_id <> 5").select("user_id", "event_id", "cents", "ts").collect():
        by_day.setdefault((row.user_id, row.ts.date()), []).append((-row.cents, row.event_id))
    newest = max(r.ts for r in events.select("ts").collect())
    expected = {
        (user, (day - day.__class__(1970, 1, 1)).days, place, event_id, -falling)
        for (user, day), entries in by_day.items()
        if day < newest.date()
        for place, (falling, event_id) in enumerate(sorted(entries)[:3], start=1)
    }
    rows = [tuple(r) for r in found.select("key", "day", "place", "id", "amount").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == expected


def test_registered_stream_runs_in_several_batches(spark):
    """One micro-batch for each piece, and the windows of one batch."""
    folder = scratch_path(spark, "several")
    found = spark_rows(streamed_hours_in_batches(spark, SMALL, folder))
    assert found == spark_rows(streamed_hours(spark, SMALL))
    commits = spark.read.text(f"{folder}/progress/commits").select(F.input_file_name()).distinct().count()
    assert commits >= 4


def test_rows_arrive_in_order_of_time(spark):
    rows = table(spark, SMALL, "events").select("event_id", "ts")
    nulls = rows.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    for given, pieces in ((rows.unionByName(nulls), 3), (nulls, 3), (rows.limit(0), 2)):
        done = drain(arriving(given, "ts", pieces, 2, "test-arriving"), "test-arrived")
        assert spark_rows(done) == spark_rows(given)
