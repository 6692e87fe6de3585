"""Row frames (lag, lead, moving aggregates) over keys of any size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.segments import PLACE, Split, plan_split


def over_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie: str,
    before: int,
    after: int,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    parts: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Adds window columns that look at most ``before`` rows back and ``after`` rows ahead.

    Each entry of ``columns`` gets the window (partitioned by key, ordered by ``by`` and the
    unique ``tie``) and may narrow its frame. Segments of a hot key get copies of the few rows
    next to them on either side, dropped again afterwards.
    """
    split = plan_split(df, keys, by, tie, parts=parts, min_rows=min_rows)
    rows = split.tag(df).withColumn("_copy", F.lit(False))
    if split.needed and (before or after):
        copies = _edge_copies(rows, split, before, after)
        rows = rows.unionByName(copies, allowMissingColumns=True)
    window = split.window(F.asc(by), F.asc(tie))
    added = {name: build(window) for name, build in columns.items()}
    return rows.withColumns(added).where(~F.col("_copy")).drop("_hot", "_solo", "_copy", *PLACE)


def _edge_copies(rows: DataFrame, split: Split, before: int, after: int) -> DataFrame:
    """For each segment, copies of the rows just before and just after it."""
    helpers = {*split.keys, *PLACE, "_hot", "_solo", "_copy"}
    names = [name for name in rows.columns if name not in helpers]
    hot = rows.where("_hot").withColumn("_row", F.struct(*names))
    order = Window.partitionBy(*split.keys).orderBy(*PLACE)
    sides = []
    if before:
        last = _nearest(hot, split, before, F.desc(split.by), F.desc(split.tie))
        lists = F.collect_list("_edge").over(order.rowsBetween(-before, -1))
        sides.append(last.withColumn("_near", F.flatten(F.reverse(lists))))
    if after:
        first = _nearest(hot, split, after, F.asc(split.by), F.asc(split.tie))
        lists = F.collect_list("_edge").over(order.rowsBetween(1, after))
        sides.append(first.withColumn("_near", F.flatten(lists)))
    copies = [
        side.select(*split.place, F.explode(F.slice("_near", 1, reach)).alias("_row"))
        for side, reach in zip(sides, [reach for reach in (before, after) if reach], strict=True)
    ]
    union = copies[0] if len(copies) == 1 else copies[0].unionByName(copies[1])
    return union.select(*split.place, "_row.*").withColumns(
        {"_copy": F.lit(True), "_hot": F.lit(True)}
    )


def _nearest(hot: DataFrame, split: Split, reach: int, *outward: Column) -> DataFrame:
    """Per segment, an array ``_edge`` of its first ``reach`` rows in the given order."""
    edge = F.collect_list(F.struct("_place", "_row"))
    by_place = F.array_sort(edge, lambda a, b: (a["_place"] - b["_place"]).cast("int"))
    return (
        hot.withColumn("_place", F.row_number().over(split.window(*outward)))
        .where(F.col("_place") <= reach)
        .groupBy(*split.place)
        .agg(F.transform(by_place, lambda item: item["_row"]).alias("_edge"))
    )
