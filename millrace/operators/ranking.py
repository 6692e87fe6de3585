"""Ranks within groups of any size, and the top rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.segments import Split, plan_split


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie: str,
    descending: bool = False,
    tiles: int = 4,
    parts: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Adds row_number, rank, dense_rank, percent_rank, cume_dist and ntile columns.

    ``row_number`` and ``ntile`` order by ``by`` (descending if asked) and then ``tie``
    ascending; the others see only ``by``. Both must be numeric and ``tie`` unique.
    """
    split = plan_split(df, keys, by, tie, parts=parts, min_rows=min_rows)
    rows = split.tag(df).withColumn("_lead", F.lit(0))
    if split.needed:
        lead = _lead_in(rows, split, descending)
        rows = rows.unionByName(lead, allowMissingColumns=True)
    direction = F.desc(by) if descending else F.asc(by)
    full = split.window(F.desc("_lead"), direction, F.asc(tie))
    peers = split.window(F.desc("_lead"), direction)
    # A frame over everything in an ordered window, so that Spark does it in the same pass.
    whole = peers.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    led = F.first("_lead").over(full) if split.needed else F.lit(0)
    ranks = {
        "_position": F.row_number().over(full) - led,
        "_rank": F.rank().over(peers),
        "_dense": F.dense_rank().over(peers),
        "_upto": F.count(F.lit(1)).over(peers),
        "_total": F.count(F.lit(1)).over(whole),
    }
    if not split.needed:
        return _shares(rows.withColumns(ranks), df.columns, tiles)
    carried = {name: F.first(name).over(full) for name in ("_carry", "_levels")}
    placed = rows.withColumns({**ranks, **carried})

    def from_before(local: str, carry: str) -> Column:
        """The local figure, less the lead-in row's own place, plus what it stands for."""
        before = F.col(carry)
        return F.when(before.isNotNull(), F.col(local) - 1 + before).otherwise(F.col(local))

    upto = F.when(F.col("_solo"), F.col("_carry.below") + F.col("_carry.alike"))
    added = placed.where("_lead = 0").withColumns(
        {
            "_position": F.col("_position") + F.coalesce("_carry.ahead", F.lit(0)),
            "_rank": from_before("_rank", "_carry.below"),
            "_dense": from_before("_dense", "_levels"),
            "_upto": F.coalesce(upto, from_before("_upto", "_carry.below")),
            "_total": F.coalesce("_carry.all", "_total"),
        }
    )
    return _shares(added, df.columns, tiles)


def _shares(rows: DataFrame, columns: Sequence[str], tiles: int) -> DataFrame:
    """The six ranking columns, from places and totals."""
    total = F.col("_total")
    percent = F.when(total > 1, (F.col("_rank") - 1) / (total - 1)).otherwise(0.0)
    return rows.select(
        *columns,
        F.col("_position").cast("long").alias("row_number"),
        F.col("_rank").cast("long").alias("rank"),
        F.col("_dense").cast("long").alias("dense_rank"),
        percent.alias("percent_rank"),
        (F.col("_upto") / total).alias("cume_dist"),
        _tile(F.col("_position").cast("long"), total, tiles).alias("ntile"),
    )


def _tile(position: Column, total: Column, tiles: int) -> Column:
    """The tile of a row: the first tiles take the remainder, one row each."""
    size = F.floor(total / tiles)
    larger = total % tiles
    head = larger * (size + 1)
    in_head = F.floor((position - 1) / (size + 1)) + 1
    in_tail = F.floor((position - head - 1) / F.greatest(size, F.lit(1))) + larger + 1
    return F.when(position <= head, in_head).otherwise(in_tail).cast("long")


def _lead_in(rows: DataFrame, split: Split, descending: bool) -> DataFrame:
    """Per segment, how many rows come before it, packed in ``_carry``, and how many levels.

    ``ahead`` counts the rows before the subsegment, ``below`` those before the segment,
    ``alike`` the rows of the segment and ``all`` those of the key. As one struct they cost an
    ordinary row a single empty field. ``_levels``, the distinct values before the segment,
    stands apart: it is dear to count, and Spark leaves it out if no dense rank is used.
    """
    counts = (
        rows.where("_hot")
        .groupBy(*split.place, "_solo")
        .agg(F.count(F.lit(1)).alias("_n"), _levels(split.by).alias("_d"))
    )
    seg = F.desc("_seg") if descending else F.asc("_seg")
    key = Window.partitionBy(*split.keys)
    ahead = key.orderBy(seg, F.asc("_sub")).rowsBetween(Window.unboundedPreceding, -1)
    below = key.orderBy(seg).rangeBetween(Window.unboundedPreceding, -1)
    segment = Window.partitionBy(*split.keys, "_seg")
    # The subsegments of a single value are one level together, counted at the first.
    first = F.row_number().over(segment.orderBy("_sub")) == 1
    level = F.when(~F.col("_solo") | F.col("_first"), F.col("_d")).otherwise(0)
    carry = F.struct(
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("ahead"),
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("below"),
        F.sum("_n").over(segment).alias("alike"),
        F.sum("_n").over(key).alias("all"),
    )
    return (
        counts.withColumn("_first", first)
        .withColumn("_d", level)
        .withColumns(
            {"_carry": carry, "_levels": F.coalesce(F.sum("_d").over(below), F.lit(0))}
        )
        .drop("_n", "_d", "_first")
        .withColumns({"_hot": F.lit(True), "_lead": F.lit(1)})
    )


def _levels(by: str) -> Column:
    """Distinct values, NULL counting as one as it does for a dense rank."""
    return F.count_distinct(by) + F.max(F.when(F.col(by).isNull(), 1).otherwise(0))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_name: str
) -> DataFrame:
    """The first k rows of each group.

    Spark cuts every map task down to k rows a group before the shuffle (a window group
    limit), so a hot group sends k rows per task and not all of its rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn(rank_name, F.row_number().over(window)).where(F.col(rank_name) <= k)
    return first.withColumn(rank_name, F.col(rank_name).cast("long"))
