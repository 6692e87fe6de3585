"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.segments import PLACE, Split, plan_split


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    spread: Sequence[str] = (),
    parts: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """One row per group with the linearly interpolated percentile for each named share.

    Spark's ``percentile`` keeps every distinct value of a group in one task's memory. Here
    the rows of a hot group are first counted by segment; only the segments that hold a
    wanted position are then sorted. A group without values has NULLs.
    """
    rows = df.where(F.col(value).isNotNull()).select(*{*keys, value, *spread})
    split = plan_split(rows, keys, value, spread=spread, parts=parts, min_rows=min_rows)
    tagged = split.tag(rows)
    if split.needed:
        tagged = _with_wanted_segments(tagged, split, shares.values())
    else:
        nothing = F.lit(None).cast("long")
        tagged = tagged.withColumns({"_before": nothing, "_all": nothing})
    order = split.window(F.asc(value))
    # A frame over everything in the ordered window, so that Spark does it in the same pass.
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = tagged.withColumns(
        {
            "_total": F.coalesce("_all", F.count(F.lit(1)).over(whole)),
            "_at": F.row_number().over(order) - 1 + F.coalesce("_before", F.lit(0)),
        }
    )
    picks = []
    for name, share in shares.items():
        position = share * (F.col("_total") - 1)
        low = F.max(F.when(F.col("_at") == F.floor(position), F.col(value)))
        high = F.max(F.when(F.col("_at") == F.ceil(position), F.col(value)))
        weight = F.max(position - F.floor(position))
        picks.append((low + (high - low) * weight).alias(name))
    found = placed.groupBy(*keys).agg(*picks)
    if not keys:
        return found
    without = df.groupBy(*keys).agg(F.count(value).alias("_n")).where("_n = 0").drop("_n")
    return found.unionByName(without, allowMissingColumns=True)


def _with_wanted_segments(
    tagged: DataFrame, split: Split, shares: Iterable[float]
) -> DataFrame:
    """Drops the segments of hot keys without a wanted position before anything is shuffled.

    The wanted segments are broadcast: two for each share of each hot key at most.
    """
    key = Window.partitionBy(*split.keys)
    earlier = key.orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        tagged.where("_hot")
        .groupBy(*split.place)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
                "_all": F.sum("_n").over(key),
            }
        )
    )
    end = F.col("_before") + F.col("_n")
    holds = F.lit(False)
    for share in shares:
        position = share * (F.col("_all") - 1)
        for wanted in (F.floor(position), F.ceil(position)):
            holds = holds | ((wanted >= F.col("_before")) & (wanted < end))
    wanted_segments = (
        sizes.where(holds)
        .drop("_n")
        .withColumnsRenamed({name: f"_its_{name}" for name in split.place})
    )
    here = F.col("_hot")
    for name in split.place:
        here = here & F.col(name).eqNullSafe(F.col(f"_its_{name}"))
    joined = tagged.join(F.broadcast(wanted_segments), here, "left")
    return joined.where(~F.col("_hot") | F.col("_all").isNotNull())
