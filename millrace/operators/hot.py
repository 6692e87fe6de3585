"""Finding the keys that hold too large a share of the rows, and joining past them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The session may name a number of rows up to which keys are never split; by default only a
# key's share of the rows counts, whatever the size of the input.
SMALL_KEY_ROWS_CONF = "spark.millrace.smallKeyRows"
# Into how many pieces a hot key is cut. By default several per shuffle partition, as pieces
# find their partition by hash and a few each even out better than one each.
PARTS_CONF = "spark.millrace.parts"
PARTS_PER_PARTITION = 4
FEWEST_PARTS = 8


def part_count(spark: SparkSession) -> int:
    by_default = PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = int(spark.conf.get(PARTS_CONF, str(by_default)))
    return max(FEWEST_PARTS, wanted)


def small_key_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SMALL_KEY_ROWS_CONF, "0"))


def hot_keys(
    df: DataFrame, keys: Sequence[str], parts: int, min_rows: int | None = None
) -> DataFrame | None:
    """The keys with more than 1/parts of all rows as a local table, or None if there are none.

    Fewer than ``parts`` keys can each hold more than 1/parts of the rows, so both the rows
    brought here and the table that is broadcast are bounded whatever the data. One pass: the
    most frequent ``parts`` keys come with the number of all rows, observed on the way.
    """
    spark = df.sparkSession
    if min_rows is None:
        min_rows = small_key_rows(spark)
    seen = Observation()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counted = counts.observe(seen, F.sum("_n").alias("total"))
    most = counted.orderBy(F.desc("_n")).limit(parts).collect()
    bar = max((seen.get["total"] or 0) // parts, min_rows)
    rows = [row[:-1] for row in most if row["_n"] > bar]
    return spark.createDataFrame(rows, counts.drop("_n").schema) if rows else None


def flag_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Adds a boolean column telling whether the row's key is one of the hot ones."""
    marks = hot.select(*[F.col(k).alias(f"_mark_{k}") for k in keys], F.lit(True).alias("_mark"))
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_mark_{key}"))
    return (
        df.join(F.broadcast(marks), condition, "left")
        .withColumn(flag, F.coalesce("_mark", F.lit(False)))
        .drop(*marks.columns)
    )


def spread_join(
    rows: DataFrame,
    unique: DataFrame,
    keys: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    parts: int | None = None,
    min_rows: int | None = None,
    nulls_match: bool = False,
) -> DataFrame:
    """Joins many rows to a side holding at most one row per key.

    ``how`` is inner, left, left_semi or left_anti. Adaptive execution splits skewed
    partitions only where both join inputs come straight from a shuffle, which is not so
    when one of them is a grouping. Here rows of a hot key are dealt out by a hash of
    ``spread_by`` (best a unique id, so that the deal is the same if a task runs again), and
    the key's one row on the other side is repeated for every share. NULL keys, which meet
    no row or with ``nulls_match`` one another, are dealt out too when they are many.
    """
    parts = parts or part_count(rows.sparkSession)
    hot = hot_keys(rows, keys, parts, min_rows)
    on = list(keys)
    if hot is not None:
        share = F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int")
        rows = flag_hot(rows, hot, keys, "_hot").withColumn(
            "_share", F.when(F.col("_hot"), share).otherwise(0)
        )
        every = F.sequence(F.lit(0), F.lit(parts - 1))
        copies = F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))
        unique = flag_hot(unique, hot, keys, "_hot").withColumn("_share", F.explode(copies))
        rows, unique = rows.drop("_hot"), unique.drop("_hot")
        on.append("_share")
    if not nulls_match:
        return rows.join(unique, on, how).drop("_share")
    unique = unique.withColumnsRenamed({key: f"_its_{key}" for key in on})
    same = F.lit(True)
    for key in on:
        same = same & F.col(key).eqNullSafe(F.col(f"_its_{key}"))
    return rows.join(unique, same, how).drop("_share", *[f"_its_{key}" for key in on])
