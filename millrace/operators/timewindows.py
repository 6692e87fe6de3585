"""Tumbling, sliding, trailing and session windows over stored events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.running import SUM, running
from millrace.operators.segments import PLACE, plan_split


def tumbling_sums(
    df: DataFrame, at: str, size: str, keys: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    window = F.window(at, size)
    totals = [F.sum(column).alias(name) for name, column in sums.items()]
    grouped = df.groupBy(window.alias("window"), *keys).agg(*totals)
    return grouped.select(F.col("window.start").alias("window_start"), *keys, *sums)


def sliding_sums(
    df: DataFrame, at: str, size: str, slide: str, keys: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Sums over overlapping windows; ``size`` must be a whole multiple of ``slide``.

    Rows are first added up per slide-wide pane. Spark then copies the panes into every
    window they belong to, where it would otherwise copy the rows.
    """
    start = "timestamp_ntz '2000-01-01 00:00:00'"
    lengths = [f"timestampdiff(MICROSECOND, {start}, {start} + INTERVAL '{n}')" for n in (size, slide)]
    whole, step = df.sparkSession.range(1).select(*map(F.expr, lengths)).first()
    if whole % step:
        raise ValueError(f"{size} is no whole multiple of {slide}")
    panes = tumbling_sums(df, at, slide, keys, sums)
    window = F.window("window_start", size, slide)
    totals = [F.sum(name).alias(name) for name in sums]
    grouped = panes.groupBy(window.alias("window"), *keys).agg(*totals)
    return grouped.select(F.col("window.start").alias("window_start"), *keys, *sums)


def trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    row_id: str,
    width: int,
    sums: Mapping[str, Column],
    parts: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Adds sums over ``at - width .. at`` of the same key, equal instants included.

    As a RANGE frame this costs rows times frame length, because Spark adds each frame up
    anew. Here every row asks for two running totals, at its instant and just before its
    frame, and subtracts. Sums must be of integers or decimals for that to be exact. The
    integer ``at`` and the unique ``row_id`` may not be NULL.
    """
    inputs = {f"_add_{name}": column for name, column in sums.items()}
    rows = df.withColumns(inputs)
    # An asker sorts before the rows of its own instant, so it sees only earlier ones.
    entering = rows.withColumns({"_order": F.col(at) * 2 + 1, "_asks": F.lit(False)})
    asking = rows.select(
        *keys, row_id, ((F.col(at) - width) * 2).alias("_order"), F.lit(True).alias("_asks")
    )
    line = entering.unionByName(asking, allowMissingColumns=True)
    folds = {f"_run_{name}": (SUM, F.col(f"_add_{name}")) for name in sums}
    found = running(line, keys, "_order", folds, [row_id, "_asks"], parts, min_rows)
    kept = [F.first(c, ignorenulls=True).alias(c) for c in df.columns if c != row_id]
    differences = []
    for name in sums:
        end = F.max(F.when(~F.col("_asks"), F.col(f"_run_{name}")))
        start = F.max(F.when(F.col("_asks"), F.col(f"_run_{name}")))
        differences.append((end - F.coalesce(start, F.lit(0))).alias(name))
    return found.groupBy(row_id).agg(*kept, *differences).select(*df.columns, *sums)


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    gap: int,
    sums: Mapping[str, Column],
    spread: Sequence[str] = (),
    parts: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Groups the rows of a key whose instants follow each other by at most ``gap``.

    Each segment of a hot key forms sessions of its own. Only the first and last of these can
    go on in a neighbouring segment, so only they are brought together by key.
    """
    inputs = {f"_add_{name}": column for name, column in sums.items()}
    rows = df.withColumns(inputs).select(*{*keys, at, *spread}, *inputs)
    split = plan_split(rows, keys, at, spread=spread, parts=parts, min_rows=min_rows)
    numbered = _numbered(split.tag(rows), split.place, F.col(at), F.col(at), gap, [at])
    totals = [F.sum(f"_add_{name}").alias(name) for name in sums]
    parts_of = numbered.groupBy(*split.place, "_hot", "_session", "_last").agg(
        F.min(at).alias("start_at"), F.max(at).alias("end_at"), *totals
    )
    names = [*keys, "start_at", "end_at", *sums]
    if not split.needed:
        return parts_of.select(*names)
    edge = (F.col("_session") == 0) | (F.col("_session") == F.col("_last"))
    marked = parts_of.withColumn("_edge", F.col("_hot") & edge)
    order = [*PLACE, "start_at"]
    pieces = marked.where("_edge").drop("_session", "_last")
    joined = _numbered(pieces, keys, F.col("start_at"), F.col("end_at"), gap, order)
    merged = joined.groupBy(*keys, "_session").agg(
        F.min("start_at").alias("start_at"),
        F.max("end_at").alias("end_at"),
        *[F.sum(name).alias(name) for name in sums],
    )
    return marked.where("not _edge").select(*names).unionByName(merged.select(*names))


def _numbered(
    df: DataFrame,
    partition: Sequence[str],
    start: Column,
    end: Column,
    gap: int,
    order: Sequence[str],
) -> DataFrame:
    """Adds ``_session``, how many times a gap wider than allowed has come so far, and
    ``_last``, how many times it comes in all."""
    window = Window.partitionBy(*partition).orderBy(*order)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    breaks = F.when(start - F.lag(end).over(window) > gap, 1).otherwise(0)
    return df.withColumn("_break", breaks).withColumns(
        {"_session": F.sum("_break").over(window), "_last": F.sum("_break").over(whole)}
    )
