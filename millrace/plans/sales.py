"""Star-schema reports: scans, filters, projections and the flagship join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.money import (
    amount,
    cents,
    exact_sum,
    limb_sums,
    net_units,
    total_of,
)
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()


@registry.query("""
    SELECT r_name, count(*) AS n_lines,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
                AS DOUBLE) AS revenue
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name
""")
def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals are taken per order, then per customer, each before the next join. The joins
    therefore meet one row per key on both sides, and a hot order or customer collapses on
    the map side."""

    def summed() -> list[Column]:
        return [F.sum(name).alias(name) for name in ("n_lines", "net_high", "net_low")]

    per_order = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("n_lines"), *limb_sums(net_units(), "net"))
    )
    per_customer = (
        table(spark, sf_dir, "orders")
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(*summed())
    )
    per_nation = (
        per_customer.join(
            table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        .groupBy("c_nationkey")
        .agg(*summed())
    )
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    per_region = (
        per_nation.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name")
        .agg(*summed())
    )
    revenue = amount(total_of(F.col("net_high"), F.col("net_low")), 4)
    return per_region.select("r_name", "n_lines", revenue.alias("revenue"))


@registry.query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
           CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                AS DOUBLE) AS net_price
    FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag <> 'N'
""")
def discounted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .where(
            (F.col("l_shipdate") >= F.expr("timestamp_ntz '1997-01-01'"))
            & (F.col("l_shipdate") < F.expr("timestamp_ntz '1998-01-01'"))
            & F.col("l_discount").between(0.05, 0.07)
            & (F.col("l_quantity") < 24)
            & (F.col("l_returnflag") != "N")
        )
        .select(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_quantity",
            amount(net_units(), 4).alias("net_price"),
        )
    )


@registry.query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines, sum(l_quantity) AS sum_qty,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
                AS DOUBLE) AS sum_net_price,
           round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_discount
    FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '2001-09-02'
    GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.expr("timestamp_ntz '2001-09-02'"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum("l_quantity").alias("sum_qty"),
            amount(exact_sum(cents("l_extendedprice")), 2).alias("sum_base_price"),
            amount(exact_sum(net_units()), 4).alias("sum_net_price"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        )
    )
