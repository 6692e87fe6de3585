"""Set operations that keep duplicates, with the copies of one row made by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One task makes at most so many copies of a row before the next task takes over.
COPIES_PER_TASK = 1_000


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as in the side that has it fewer times."""
    return _copies(_counts(left, right), F.least("_left", "_right"), left.columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of the left side as often as it outnumbers the right side's."""
    return _copies(_counts(left, right), F.col("_left") - F.col("_right"), left.columns)


def _counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """How often each row occurs on either side; map tasks send one count per row."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select("*", one.alias("_left"), none.alias("_right")).union(
        right.select("*", none.alias("_left"), one.alias("_right"))
    )
    return both.groupBy(*left.columns).agg(
        F.sum("_left").alias("_left"), F.sum("_right").alias("_right")
    )


def _copies(
    counts: DataFrame, wanted: Column, columns: list[str], most: int = COPIES_PER_TASK
) -> DataFrame:
    """Repeats each row as wanted.

    Spark's own INTERSECT ALL and EXCEPT ALL make all copies of a row in one task. Here every
    row is first dealt out as shares of at most so many copies, and each share makes its own.
    """
    rows = counts.select(*columns, wanted.alias("_n")).where("_n > 0")
    last = F.call_function("div", F.col("_n") - 1, F.lit(most))
    rest = F.when(F.col("_share") == last, F.col("_n") - last * most).otherwise(most)
    shares = (
        rows.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("_n", rest)
        .repartition("_share", *columns)
        .drop("_share")
    )
    ones = F.array_repeat(F.lit(True), F.col("_n").cast("int"))
    return shares.select(*columns, F.explode(ones).alias("_one")).drop("_one")
