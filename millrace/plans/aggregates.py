"""Aggregates: grouping sets, distinct and approximate counts, percentiles, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.money import amount, cents, exact_sum
from millrace.operators.grouping import grouping_totals, pivot_sums
from millrace.operators.percentiles import exact_percentiles
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()

# The types with a column of their own.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _orders_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderstatus",
        "o_orderpriority",
        F.year("o_orderdate").alias("order_year"),
        cents("o_totalprice").alias("price"),
    )


def _totals() -> dict[str, Column]:
    return {"n_orders": F.count(F.lit(1)), "total": exact_sum(F.col("price"))}


@registry.query("""
    SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
           CAST(grouping(o_orderstatus) AS INTEGER) AS all_statuses,
           CAST(grouping(o_orderpriority) AS INTEGER) AS all_priorities
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"all_statuses": "o_orderstatus", "all_priorities": "o_orderpriority"}
    dims = ["o_orderstatus", "o_orderpriority"]
    totals = grouping_totals(_orders_by_year(spark, sf_dir), dims, "rollup", _totals(), flags)
    return totals.withColumn("total", amount(F.col("total"), 2))


@registry.query("""
    SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total
    FROM orders GROUP BY CUBE (o_orderstatus, year(o_orderdate))
""")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["o_orderstatus", "order_year"]
    totals = grouping_totals(_orders_by_year(spark, sf_dir), dims, "cube", _totals())
    return totals.withColumn("total", amount(F.col("total"), 2))


@registry.query("""
    SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS order_year,
           count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total
    FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus, year(o_orderdate)), (o_orderpriority), ())
""")
def order_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["o_orderstatus", "o_orderpriority", "order_year"]
    sets = [["o_orderstatus", "order_year"], ["o_orderpriority"], []]
    totals = grouping_totals(_orders_by_year(spark, sf_dir), dims, sets, _totals())
    return totals.withColumn("total", amount(F.col("total"), 2))


@registry.query("""
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders,
           count(DISTINCT l_partkey) AS n_parts, count(*) AS n_lines
    FROM lineitem GROUP BY l_returnflag
""")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.count_distinct("l_orderkey").alias("n_orders"),
            F.count_distinct("l_partkey").alias("n_parts"),
            F.count("*").alias("n_lines"),
        )
    )


@registry.query("""
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders,
           true AS sketch_within_5_percent, true AS direct_within_10_percent
    FROM lineitem GROUP BY l_returnflag
""")
def approximate_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two estimates beside the exact count, and whether they keep to their bounds.

    One estimate merges the sketches of each flag's statuses. The other sees each order of a flag
    once, which leaves it as it is: beside count_distinct over the lines, Spark would give every
    order of a flag a sketch of its own.
    """
    lines = table(spark, sf_dir, "lineitem")
    merged = (
        lines.groupBy("l_returnflag", "l_linestatus")
        .agg(F.hll_sketch_agg("l_orderkey").alias("part"))
        .groupBy(F.col("l_returnflag").alias("flag"))
        .agg(F.hll_sketch_estimate(F.hll_union_agg("part")).alias("sketch"))
    )
    orders = lines.select("l_returnflag", "l_orderkey").distinct()
    counted = orders.groupBy("l_returnflag").agg(
        F.count("l_orderkey").alias("n_orders"),
        F.approx_count_distinct("l_orderkey", 0.02).alias("direct"),
    )
    estimates = counted.join(merged, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return estimates.select(
        "l_returnflag",
        "n_orders",
        (F.abs(F.col("sketch") - F.col("n_orders")) <= 0.05 * F.col("n_orders")).alias(
            "sketch_within_5_percent"
        ),
        (F.abs(F.col("direct") - F.col("n_orders")) <= 0.1 * F.col("n_orders")).alias(
            "direct_within_10_percent"
        ),
    )


@registry.query("""
    SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05,
           round(quantile_cont(value, 0.5), 6) AS p50,
           round(quantile_cont(value, 0.95), 6) AS p95,
           round(quantile_cont(value, 0.999), 6) AS p999
    FROM events GROUP BY event_type
""")
def event_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p999": 0.999}
    events = table(spark, sf_dir, "events")
    found = exact_percentiles(events, ["event_type"], "value", shares, ["event_id"])
    return found.select("event_type", *[F.round(name, 6).alias(name) for name in shares])


@registry.query("""
    SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 6) AS lower_quarter,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS middle,
           round(quantile_cont(l_extendedprice, 0.75), 6) AS upper_quarter
    FROM lineitem GROUP BY l_suppkey
""")
def supplier_price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {"lower_quarter": 0.25, "middle": 0.5, "upper_quarter": 0.75}
    lines = table(spark, sf_dir, "lineitem")
    spread = ["l_orderkey", "l_partkey", "l_linenumber"]
    found = exact_percentiles(lines, ["l_suppkey"], "l_extendedprice", shares, spread)
    return found.select("l_suppkey", *[F.round(name, 6).alias(name) for name in shares])


@registry.query("""
    SELECT event_type, count(*) AS n, round(stddev_samp(value), 6) AS sd,
           round(var_pop(value), 6) AS variance,
           round(corr(value, CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS corr_k,
           round(covar_samp(value, CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6)
               AS covar_k,
           min(value) AS lowest, max(value) AS highest
    FROM events GROUP BY event_type
""")
def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return (
        table(spark, sf_dir, "events")
        .select("event_type", "value", F.from_json("props", "k double")["k"].alias("k"))
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"),
            F.round(F.stddev_samp("value"), 6).alias("sd"),
            F.round(F.var_pop("value"), 6).alias("variance"),
            F.round(F.corr("value", k), 6).alias("corr_k"),
            F.round(F.covar_samp("value", k), 6).alias("covar_k"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
        )
    )


@registry.query("""
    SELECT strftime(ts, '%Y-%m-%d') AS day,
           CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT))
                FILTER (event_type = 'click'), 0) AS BIGINT) AS click,
           CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT))
                FILTER (event_type = 'error'), 0) AS BIGINT) AS error,
           CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT))
                FILTER (event_type = 'purchase'), 0) AS BIGINT) AS purchase,
           CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT))
                FILTER (event_type = 'signup'), 0) AS BIGINT) AS signup,
           CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT))
                FILTER (event_type = 'view'), 0) AS BIGINT) AS view,
           CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT))
                FILTER (NOT coalesce(event_type IN ('click', 'error', 'purchase', 'signup',
                                                    'view'), false)), 0) AS BIGINT) AS other
    FROM events GROUP BY ALL
""")
def daily_cents_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", cents("value").alias("cents")
    )
    return pivot_sums(events, ["day"], "event_type", EVENT_TYPES, F.col("cents")).na.fill(0)
