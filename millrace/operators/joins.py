"""Joins that Spark has no single operator for, or that need help with a hot key.

Plain inner, left, semi and anti joins are left to Spark: it broadcasts a side only after
checking its size, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.hot import spread_join
from millrace.operators.running import BEST, running


def keep_matched(
    rows: DataFrame,
    others: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    unique: bool = False,
) -> DataFrame:
    """The rows whose key occurs among the others (a semi join).

    Only distinct keys of the other side are shuffled; repeats collapse before that. With
    ``unique`` each key is in one row, so that none can be hot and none is looked for.
    """
    return _kept(rows, others, keys, spread_by, unique, "left_semi")


def keep_unmatched(
    rows: DataFrame,
    others: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    unique: bool = False,
) -> DataFrame:
    """The rows whose key does not occur among the others (an anti join)."""
    return _kept(rows, others, keys, spread_by, unique, "left_anti")


def _kept(
    rows: DataFrame,
    others: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    unique: bool,
    how: str,
) -> DataFrame:
    distinct = others.select(*keys).distinct()
    if unique:
        return rows.join(distinct, list(keys), how)
    return spread_join(rows, distinct, keys, how, spread_by)


def full_outer_with_unique(
    rows: DataFrame, unique: DataFrame, keys: Sequence[str], spread_by: Sequence[str]
) -> DataFrame:
    """A full outer join of many rows with a side of at most one row per key.

    A left join that can be split, and the unique rows that met nothing.
    """
    met = spread_join(rows, unique, keys, "left", spread_by)
    return met.unionByName(
        keep_unmatched(unique, rows, keys, keys, unique=True), allowMissingColumns=True
    )


def full_outer(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_spread: Sequence[str],
    right_spread: Sequence[str],
) -> DataFrame:
    """A full outer join on like-named keys where a key may be hot on either side.

    Adaptive execution cannot split a full outer join, but it can split both sides of an
    inner join; the unmatched rows of each side come from two anti joins. Where both sides
    hold one row per key, Spark's own full join does the same in one shuffle.
    """
    matched = left.join(right, list(keys))
    only_left = keep_unmatched(left, right, keys, left_spread)
    only_right = keep_unmatched(right, left, keys, right_spread)
    return matched.unionByName(only_left, allowMissingColumns=True).unionByName(
        only_right, allowMissingColumns=True
    )


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    before: int,
    after: int,
) -> DataFrame:
    """All pairs of one key with ``left_at - before <= right_at <= left_at + after``.

    Both instants are integers (such as microseconds). Time is cut into buckets as wide as
    the interval and the bucket joins the key, so a row meets only rows near it in time and a
    hot key spreads over its buckets. All pairs are the result: their number grows with the
    square of a key's rate. The interval of a left row touches at most two buckets
    and a right row lies in one, so no pair is found twice.
    """
    width = before + after + 1
    starts, ends = F.col(left_at) - before, F.col(left_at) + after
    spans = F.array_distinct(F.array(_bucket(starts, width), _bucket(ends, width)))
    near_left = left.withColumn("_bucket", F.explode(spans))
    near_right = right.withColumn("_bucket", _bucket(F.col(right_at), width))
    inside = F.col(right_at).between(starts, ends)
    return near_left.join(near_right, [*keys, "_bucket"]).where(inside).drop("_bucket")


def _bucket(at: Column, width: int) -> Column:
    """Floor division in whole numbers, also for instants before 1970."""
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    right_tie: str,
    values: Sequence[str],
    left_id: Sequence[str],
    parts: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Every left row with the values of the latest right row of its key not after it.

    ``at`` is an integer instant on both sides; among right rows of the same instant the one
    with the largest ``right_tie`` wins. Left rows without such a row get NULLs; a NULL key or
    instant has none. The two sides are laid on one timeline, right before left at equal instants, and the latest right
    row is a running best: no pairs are formed and a hot key is cut along time.
    """
    latest = F.struct(
        F.col(at).alias("_at"), F.col(right_tie).alias("_tie"), F.struct(*values).alias("_values")
    )
    names = left.columns
    left_rows = left.select(
        *keys,
        (F.col(at) * 2 + 1).alias("_order"),
        F.struct(*names).alias("_left"),
        F.xxhash64(*left_id).alias("_deal"),
    )
    right_rows = right.dropna(subset=[*keys, at]).select(
        *keys,
        (F.col(at) * 2).alias("_order"),
        latest.alias("_right"),
        F.xxhash64(*keys, at, right_tie).alias("_deal"),
    )
    line = left_rows.unionByName(right_rows, allowMissingColumns=True)
    found = running(
        line, keys, "_order", {"_latest": (BEST, F.col("_right"))}, ["_deal"], parts, min_rows
    )
    return found.where(F.col("_left").isNotNull()).select(
        "_left.*", *[F.col(f"_latest._values.{value}").alias(value) for value in values]
    )


def paired_with_group(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], spread_by: Sequence[str]
) -> DataFrame:
    """Rows with the columns of their group's summary; rows without a key are a group too."""
    return spread_join(rows, groups, keys, "left", spread_by, nulls_match=True)
