"""Ranking, neighbouring rows, running and trailing sums, time windows and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.money import cents
from millrace.functions.times import HOUR, MINUTE, micros
from millrace.operators.frames import over_neighbours
from millrace.operators.joins import paired_with_group
from millrace.operators.ranking import ranked, top_per_group
from millrace.operators.running import SUM, running
from millrace.operators.timewindows import sessions, sliding_sums, trailing_sums, tumbling_sums
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()


def _timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        micros(events, "ts").alias("at"),
        cents("value").alias("cents"),
    )


@registry.query("""
    SELECT o_orderkey, o_orderstatus, row_number() OVER full_order AS row_number,
           rank() OVER by_price AS rank, dense_rank() OVER by_price AS dense_rank,
           percent_rank() OVER by_price AS percent_rank, cume_dist() OVER by_price AS cume_dist,
           ntile(10) OVER full_order AS ntile
    FROM orders
    WINDOW by_price AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC),
           full_order AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)
""")
def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    found = ranked(orders, ["o_orderstatus"], "o_totalprice", "o_orderkey", True, tiles=10)
    return found.drop("o_totalprice")


@registry.query("""
    SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS row_number,
           rank() OVER by_size AS rank, dense_rank() OVER by_size AS dense_rank,
           percent_rank() OVER by_size AS percent_rank, cume_dist() OVER by_size AS cume_dist,
           ntile(7) OVER (ORDER BY p_size, p_partkey) AS ntile
    FROM part WINDOW by_size AS (ORDER BY p_size)
""")
def part_ranks_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group, few distinct sizes: whole segments are a single value."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return ranked(parts, [], "p_size", "p_partkey", tiles=7).drop("p_size")


@registry.query("""
    SELECT event_id, lag(value) OVER w AS previous_value, lead(event_type) OVER w AS next_type,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER
                (w ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS moving_cents,
           max(value) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent_peak
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def event_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select(
        "event_id", "user_id", "event_type", "value", micros(events, "ts").alias("at")
    )
    columns = {
        "previous_value": lambda w: F.lag("value").over(w),
        "next_type": lambda w: F.lead("event_type").over(w),
        "moving_cents": lambda w: F.sum(cents("value")).over(w.rowsBetween(-3, 1)),
        "recent_peak": lambda w: F.max("value").over(w.rowsBetween(-3, 0)),
    }
    found = over_neighbours(rows, ["user_id"], "at", "event_id", 3, 1, columns)
    return found.select("event_id", *columns)


@registry.query("""
    SELECT event_id, first_value(event_id) OVER w AS first_event,
           CAST((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) // 1000000 AS BIGINT)
               AS seconds_since
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def since_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of a whole partition is a grouping; no window is needed for it."""
    events = _timed_events(spark, sf_dir).select("event_id", "user_id", "at")
    first = events.groupBy("user_id").agg(
        F.min(F.struct(F.col("at").alias("at"), F.col("event_id").alias("id"))).alias("first")
    )
    found = paired_with_group(events, first, ["user_id"], ["event_id"])
    since = F.floor((F.col("at") - F.col("first.at")) / 1_000_000)
    return found.select(
        "event_id", F.col("first.id").alias("first_event"), since.alias("seconds_since")
    )


@registry.query("""
    SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS so_far,
           count(*) OVER w AS n_so_far
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)
""")
def running_cents_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _timed_events(spark, sf_dir).select("event_id", "event_type", "at", "cents")
    folds = {"so_far": (SUM, F.col("cents")), "n_so_far": (SUM, F.lit(1))}
    found = running(events, ["event_type"], "at", folds, ["event_id"])
    return found.select("event_id", "so_far", "n_so_far")


@registry.query("""
    SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents_6h,
           count(*) OVER w AS n_6h
    FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts
                 RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)
""")
def trailing_six_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _timed_events(spark, sf_dir).select("event_id", "event_type", "at", "cents")
    sums = {"cents_6h": F.col("cents"), "n_6h": F.lit(1)}
    found = trailing_sums(events, ["event_type"], "at", "event_id", 6 * HOUR, sums)
    return found.select("event_id", *sums)


@registry.query("""
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
           event_type, count(*) AS n,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events GROUP BY ALL
""")
def hourly_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = {"n": F.lit(1), "cents": F.col("cents")}
    found = tumbling_sums(_timed_events(spark, sf_dir), "ts", "1 hour", ["event_type"], sums)
    return found.withColumn("window_start", _stamp("window_start"))


@registry.query("""
    WITH spans AS (
        SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(back AS BIGINT)) AS start,
               event_type, CAST(round(value * 100) AS BIGINT) AS cents
        FROM events CROSS JOIN range(0, 6) AS r(back))
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
           CAST(sum(cents) AS BIGINT) AS cents
    FROM spans GROUP BY ALL
""")
def six_hours_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = {"n": F.lit(1), "cents": F.col("cents")}
    events = _timed_events(spark, sf_dir)
    found = sliding_sums(events, "ts", "6 hours", "1 hour", ["event_type"], sums)
    return found.withColumn("window_start", _stamp("window_start"))


@registry.query("""
    WITH marked AS (
        SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents,
               CASE WHEN ts - lag(ts) OVER w > INTERVAL 8 HOUR THEN 1 ELSE 0 END AS breaks
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (
        SELECT *, sum(breaks) OVER (PARTITION BY user_id ORDER BY ts
                                    ROWS UNBOUNDED PRECEDING) AS session
        FROM marked)
    SELECT user_id, epoch_us(min(ts)) AS start_at, epoch_us(max(ts)) AS end_at,
           count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents
    FROM numbered GROUP BY user_id, session
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = {"n": F.lit(1), "cents": F.col("cents")}
    events = _timed_events(spark, sf_dir)
    return sessions(events, ["user_id"], "at", 8 * HOUR, sums, ["event_id"])


@registry.query("""
    WITH marked AS (
        SELECT event_type, ts, event_id,
               CASE WHEN ts - lag(ts) OVER w > INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS breaks
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    numbered AS (
        SELECT *, sum(breaks) OVER (PARTITION BY event_type ORDER BY ts, event_id
                                    ROWS UNBOUNDED PRECEDING) AS session
        FROM marked)
    SELECT event_type, epoch_us(min(ts)) AS start_at, epoch_us(max(ts)) AS end_at, count(*) AS n
    FROM numbered GROUP BY event_type, session
""")
def bursts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of very large keys: every event type is cut along time."""
    events = _timed_events(spark, sf_dir)
    return sessions(events, ["event_type"], "at", 20 * MINUTE, {"n": F.lit(1)}, ["event_id"])


@registry.query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def dearest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@registry.query("""
    SELECT o_orderpriority, o_orderkey, o_totalprice, place FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderpriority
                                     ORDER BY o_totalprice DESC, o_orderkey) AS place
        FROM orders)
    WHERE place <= 10
""")
def dearest_orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return top_per_group(orders, ["o_orderpriority"], order, 10, "place")


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")
