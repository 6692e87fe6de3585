"""Joins: semi, anti, full outer, interval, as-of, set operations, correlated averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.money import amount, cents, exact_sum, net_units
from millrace.functions.times import HOUR, SECOND, micros
from millrace.operators.joins import (
    as_of_join,
    full_outer_with_unique,
    interval_join,
    keep_matched,
    keep_unmatched,
    paired_with_group,
)
from millrace.operators.setops import except_all, intersect_all
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()


@registry.query("""
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    returned = (
        table(spark, sf_dir, "lineitem")
        .where("l_returnflag = 'R'")
        .select(F.col("l_orderkey").alias("o_orderkey"))
    )
    return keep_matched(orders, returned, ["o_orderkey"], ["o_orderkey"], unique=True)


@registry.query("""
    SELECT o_orderkey, o_custkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return keep_unmatched(orders, lines, ["o_orderkey"], ["o_orderkey"], unique=True)


@registry.query("""
    WITH urgent AS (SELECT o_orderkey, o_totalprice FROM orders
                    WHERE o_orderpriority = '1-URGENT'),
         returned AS (SELECT l_orderkey, count(*) AS n_returned,
                             CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
                                      * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS lost
                      FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, o_totalprice, n_returned, lost
    FROM urgent FULL OUTER JOIN returned ON o_orderkey = l_orderkey
""")
def urgent_or_returned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides hold one row per order, so Spark's own full join has no hot key to fear."""
    urgent = (
        table(spark, sf_dir, "orders")
        .where("o_orderpriority = '1-URGENT'")
        .select(F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    )
    returned = (
        table(spark, sf_dir, "lineitem")
        .where("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("orderkey"))
        .agg(F.count("*").alias("n_returned"), amount(exact_sum(net_units()), 4).alias("lost"))
    )
    return urgent.join(returned, "orderkey", "full")


@registry.query("""
    WITH urgent AS (SELECT o_orderkey, o_totalprice FROM orders
                    WHERE o_orderpriority = '1-URGENT'),
         returned AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
                      WHERE l_returnflag = 'R')
    SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, o_totalprice, l_partkey, l_linenumber
    FROM urgent FULL OUTER JOIN returned ON o_orderkey = l_orderkey
""")
def urgent_orders_and_bulk_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row by row: lines of one order may be many, but an order is one row."""
    urgent = (
        table(spark, sf_dir, "orders")
        .where("o_orderpriority = '1-URGENT'")
        .select(F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    )
    returned = (
        table(spark, sf_dir, "lineitem")
        .where("l_returnflag = 'R'")
        .select(F.col("l_orderkey").alias("orderkey"), "l_partkey", "l_linenumber")
    )
    return full_outer_with_unique(
        returned, urgent, ["orderkey"], ["l_partkey", "l_linenumber", "orderkey"]
    )


@registry.query("""
    SELECT p.event_id AS purchase_id, v.event_id AS view_id,
           CAST((epoch_us(p.ts) - epoch_us(v.ts)) // 1000000 AS BIGINT) AS seconds_between
    FROM events p JOIN events v
      ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts
    WHERE p.event_type = 'purchase' AND v.event_type = 'view'
""")
def views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = micros(events, "ts")
    purchases = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), at.alias("bought_at")
    )
    views = events.where("event_type = 'view'").select(
        "user_id", F.col("event_id").alias("view_id"), at.alias("seen_at")
    )
    pairs = interval_join(purchases, views, ["user_id"], "bought_at", "seen_at", 6 * HOUR, 0)
    between = F.floor((F.col("bought_at") - F.col("seen_at")) / SECOND)
    return pairs.select("purchase_id", "view_id", between.alias("seconds_between"))


@registry.query("""
    SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
      ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def latest_view_at_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = micros(events, "ts").alias("at")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", at)
    views = events.where("event_type = 'view'").select(
        "user_id", at, F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    return as_of_join(
        purchases, views, ["user_id"], "at", "view_id", ["view_id", "view_value"], ["event_id"]
    ).drop("at")


@registry.query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
    WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice)
                          FROM orders i WHERE i.o_custkey = o.o_custkey)
""")
def orders_above_customer_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated average, decorrelated into a grouping that is joined back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    total = exact_sum(cents("o_totalprice"))
    bars = orders.groupBy("o_custkey").agg(total.alias("total"), F.count("*").alias("n"))
    above = cents("o_totalprice").cast("decimal(20,0)") * 2 * F.col("n") > F.col("total") * 3
    return (
        paired_with_group(orders, bars, ["o_custkey"], ["o_orderkey"])
        .where(above)
        .drop("total", "n")
    )


@registry.query("""
    SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier
""")
def trading_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return buyers.union(sellers).distinct()


@registry.query("""
    SELECT o_custkey AS custkey FROM orders INTERSECT ALL SELECT user_id FROM events
""")
def orders_met_by_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    visitors = table(spark, sf_dir, "events").select(F.col("user_id").alias("custkey"))
    return intersect_all(buyers, visitors)


@registry.query("""
    SELECT user_id FROM events EXCEPT ALL SELECT o_custkey FROM orders
""")
def events_not_met_by_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    visitors = table(spark, sf_dir, "events").select("user_id")
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    return except_all(visitors, buyers)
