"""Streaming queries over the events table, run until the source is drained.

In append mode a window is sent on once the watermark (newest time less ten minutes) has
passed it, so the last windows stay open; the SQL leaves them out in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.money import cents
from millrace.plans.registry import Registry
from millrace.sources import arriving, stream_table, table
from millrace.streaming.drain import drain, session_conf
from millrace.streaming.matching import once_each, stream_interval_join
from millrace.streaming.state import largest_of_day
from millrace.streaming.windows import (
    SESSION_CONF,
    on_event_time,
    stream_sessions,
    stream_window_sums,
)

registry = Registry()

DELAY = "10 minutes"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_event_time(stream_table(spark, sf_dir, "events"), "ts", DELAY)


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_HOURS_SQL = """
    WITH closed AS (SELECT max(ts) - INTERVAL 10 MINUTE AS upto FROM events)
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
           event_type, count(*) AS n,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events, closed
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= upto
    GROUP BY ALL
"""


@registry.query(_HOURS_SQL)
def streamed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = {"n": F.lit(1), "cents": cents("value")}
    found = stream_window_sums(_events(spark, sf_dir), "ts", "1 hour", None, ["event_type"], sums)
    done = drain(found, "hours")
    return done.select(_stamp("window_start"), "event_type", "n", "cents")


@registry.query(_HOURS_SQL)
def streamed_hours_in_batches(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The events arrive in four pieces, each a micro-batch, and windows cross their edges."""
    events = arriving(table(spark, sf_dir, "events"), "ts", 4, 2, "events")
    sums = {"n": F.lit(1), "cents": cents("value")}
    found = stream_window_sums(on_event_time(events, "ts", DELAY), "ts", "1 hour", None, ["event_type"], sums)
    done = drain(found, "hours-in-batches", folder)
    return done.select(_stamp("window_start"), "event_type", "n", "cents")


@registry.query("""
    WITH closed AS (SELECT max(ts) - INTERVAL 10 MINUTE AS upto FROM events),
    marked AS (
        SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 8 HOUR
                                 THEN 1 ELSE 0 END AS breaks
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (
        SELECT *, sum(breaks) OVER (PARTITION BY user_id ORDER BY ts
                                    ROWS UNBOUNDED PRECEDING) AS session FROM marked),
    grouped AS (
        SELECT user_id, min(ts) AS start_at, max(ts) + INTERVAL 8 HOUR AS end_at, count(*) AS n
        FROM numbered GROUP BY user_id, session)
    SELECT user_id, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at,
           strftime(end_at, '%Y-%m-%d %H:%M:%S') AS end_at, n
    FROM grouped, closed WHERE end_at <= upto
""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    with session_conf(spark, SESSION_CONF):
        done = drain(
            stream_sessions(events, "ts", "8 hours", ["user_id"], {"n": F.lit(1)}), "sessions"
        )
    return done.select("user_id", _stamp("start_at"), _stamp("end_at"), "n")


@registry.query("""
    SELECT event_type, count(*) AS n,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events GROUP BY event_type
""")
def streamed_once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors arrive twice, as from a source that repeats a failed delivery."""
    needed = ["event_id", "ts", "event_type", "value"]
    events = stream_table(spark, sf_dir, "events").select(*needed)
    again = (
        stream_table(spark, sf_dir, "events")
        .select(*needed)
        .where("event_type in ('purchase', 'error')")
    )
    both = events.unionByName(again)
    done = drain(once_each(both, ["event_id"], "ts", DELAY), "once")
    return done.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(cents("value")).alias("cents")
    )


@registry.query("""
    SELECT p.event_id AS purchase_id, v.event_id AS view_id
    FROM events p JOIN events v
      ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 2 HOUR AND p.ts
    WHERE p.event_type = 'purchase' AND v.event_type = 'view'
""")
def streamed_views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    purchases = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought_at")
    )
    views = (
        _events(spark, sf_dir)
        .where("event_type = 'view'")
        .select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen_at"))
    )
    pairs = stream_interval_join(purchases, views, ["user_id"], "bought_at", "seen_at", 7200)
    return drain(pairs, "pairs").select("purchase_id", "view_id")


@registry.query("""
    WITH closed AS (SELECT max(ts) - INTERVAL 10 MINUTE AS upto FROM events),
    placed AS (
        SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS on_day, event_id,
               CAST(round(value * 100) AS BIGINT) AS cents,
               row_number() OVER (PARTITION BY user_id, date_trunc('day', ts)
                                  ORDER BY round(value * 100) DESC, event_id) AS place
        FROM events)
    SELECT user_id, strftime(on_day, '%Y-%m-%d') AS day, CAST(place AS INTEGER) AS place,
           event_id, cents
    FROM placed, closed WHERE place <= 3 AND on_day + INTERVAL 1 DAY <= upto
""")
def streamed_largest_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_table(spark, sf_dir, "events").withColumn("cents", cents("value"))
    done = drain(largest_of_day(events, "user_id", "ts", "event_id", "cents", 3, DELAY), "largest")
    return done.select(
        F.col("key").alias("user_id"),
        F.date_from_unix_date(F.col("day").cast("int")).cast("string").alias("day"),
        "place",
        F.col("id").alias("event_id"),
        F.col("amount").alias("cents"),
    )
