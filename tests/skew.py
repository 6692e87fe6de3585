"""Test inputs derived from the given tables, with one key holding a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import micros
from millrace.sources import table


def skewed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events where user 7 has a third of all rows, an instant of theirs is very frequent,
    and an eighth of the users are NULL."""
    events = table(spark, sf_dir, "events")
    hot = F.col("event_id") % 3 == 0
    burst = hot & (F.col("event_id") % 2 == 0) & (F.col("event_id") > 400)
    instant = F.expr("timestamp_ntz '2024-01-20 12:00:00'")
    return (
        events.withColumn("user_id", F.when(hot, 7).otherwise(F.col("user_id")))
        .withColumn("user_id", F.when(F.col("event_id") % 8 != 1, F.col("user_id")))
        .withColumn("ts", F.when(burst, instant).otherwise(F.col("ts")))
        .withColumn("at", micros(events, "ts"))
        .withColumn("at", F.when(burst, micros_of_burst()).otherwise(F.col("at")))
        .withColumn("cents", F.round(F.col("value") * 100).cast("long"))
        .select("event_id", "ts", "user_id", "event_type", "at", "cents")
    )


def micros_of_burst():
    return F.lit(1_705_752_000_000_000)
