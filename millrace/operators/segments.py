"""Cutting the hot keys of a window along its ordering.

A Spark window puts all rows of a partition key into one task. For a key holding a large
share of the rows that task becomes the job. Here such a key is cut into segments along the
ordering column, and each segment is its own window partition. What a segment needs to know
about the rows before it reaches it as *lead-in* rows, made from one small summary per
segment, so the result is that of the uncut window.

Cut points are computed once and become literals of the plan. A lost task therefore sends
every row to the same segment again.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.hot import flag_hot, hot_keys, part_count, small_key_rows

PLACE = ["_seg", "_sub"]


Point = int | float | Decimal


def _literal(point: Point) -> str:
    if isinstance(point, int):
        return f"{point}L"
    if isinstance(point, Decimal):
        return f"{point:f}BD"
    return f"{point!r}D" if math.isfinite(point) else f"double('{point!r}')"


def _in_order(points: Iterable[Point]) -> list[Point]:
    """Sorted as Spark sorts: NaN last."""
    return sorted(points, key=lambda point: (point != point, point))


def _cuts(points: Sequence[Point]) -> Counter[Point]:
    """How often each point was found; all NaNs are one point."""
    return Counter(math.nan if point != point else point for point in points)


def _array(points: Sequence[Point]) -> str:
    return f"array({', '.join(map(_literal, points))})"


# More points than this would make the compiled search longer than a method may be.
MOST_COMPILED = 128


def count_below(points: Sequence[Point], value: Column, inclusive: bool = False) -> Column:
    """How many of the sorted points lie below the value (or at it).

    A binary search of nested conditions, which Spark compiles; a row costs the logarithm of the
    number of points. Of more points every k-th is searched so, and a run of k within an array.
    """

    def below(point: Column) -> Column:
        return (point <= value) if inclusive else (point < value)

    def search(some: Sequence[Point], low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        right, left = search(some, middle + 1, high), search(some, low, middle)
        return F.when(below(F.expr(_literal(some[middle]))), right).otherwise(left)

    if len(points) <= MOST_COMPILED:
        return search(points, 0, len(points))
    width = -(-len(points) // MOST_COMPILED)
    runs = [points[i : i + width] for i in range(0, len(points), width)]
    table = F.expr(f"array({', '.join(map(_array, runs))})")
    run = search([run[0] for run in runs], 0, len(runs))
    within = F.size(F.filter(F.element_at(table, F.greatest(run, F.lit(1))), below))
    return F.when(run == 0, 0).otherwise((run - 1) * width + within)


def _thinned(points: Sequence[Point], wanted: int) -> tuple[Point, ...]:
    """About as many of the sorted points as wanted, evenly chosen, each once."""
    step = max(1, len(points) // wanted)
    return tuple(_in_order(_cuts(points[step - 1 :: step])))


@dataclass(frozen=True)
class Split:
    """Where the hot keys are cut.

    ``points`` cut the ordering column. ``solid`` holds values of it that are themselves too
    frequent for one task: each gets a segment to itself, cut further into subsegments by
    ``ties`` (points of the tie-breaking column) or, where order among equals does not
    matter, by a hash of the ``spread`` columns. Those should identify a row: a hash of the
    row's own values, unlike a random number, deals it out alike if its task runs again.
    """

    keys: tuple[str, ...]
    by: str
    tie: str | None
    hot: DataFrame | None
    everything_hot: bool
    points: tuple[Point, ...]
    solid: tuple[Point, ...]
    ties: tuple[tuple[Point, ...], ...]
    spread: tuple[str, ...]
    parts: int

    @property
    def needed(self) -> bool:
        return self.everything_hot or self.hot is not None

    @property
    def place(self) -> list[str]:
        return [*self.keys, *PLACE]

    def window(self, *order: Column | str) -> WindowSpec:
        return Window.partitionBy(*self.place).orderBy(*order)

    def flagged(self, df: DataFrame) -> DataFrame:
        if self.everything_hot:
            return df.withColumn("_hot", F.lit(True))
        if self.hot is None:
            return df.withColumn("_hot", F.lit(False))
        return flag_hot(df, self.hot, self.keys, "_hot")

    def tag(self, df: DataFrame) -> DataFrame:
        """Adds ``_hot``, the segment ``_seg``, the subsegment ``_sub`` and ``_solo``, true
        where the segment holds a single value."""
        df = self.flagged(df)
        if not self.needed:
            return df.withColumns({"_seg": F.lit(0), "_sub": F.lit(0), "_solo": F.lit(False)})
        value = F.col(self.by)
        segment = count_below(self.points, value) + count_below(self.solid, value, inclusive=True)
        solo, sub = F.lit(False), F.lit(0)
        if self.solid:
            rank = count_below(self.solid, value, inclusive=True)
            nearest = F.element_at(F.expr(_array(self.solid)), F.greatest(rank, F.lit(1)))
            solo = F.coalesce(value == nearest, F.lit(False))
            sub = F.when(solo, self._within(rank)).otherwise(0)
        hot = F.col("_hot")
        return df.withColumns(
            {
                "_seg": F.when(hot, segment).otherwise(0),
                "_sub": F.when(hot, sub).otherwise(0),
                "_solo": hot & solo,
            }
        )

    def _within(self, rank: Column) -> Column:
        if self.tie is None:
            return F.pmod(F.xxhash64(*self.spread), F.lit(self.parts)).cast("int")
        tables = F.expr(f"array({', '.join(map(_array, self.ties))})")
        points = F.element_at(tables, F.greatest(rank, F.lit(1)))
        return F.size(F.filter(points, lambda point: point < F.col(self.tie)))


def plan_split(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie: str | None = None,
    spread: Sequence[str] = (),
    parts: int | None = None,
    min_rows: int | None = None,
) -> Split:
    """Looks for hot keys and, if there are any, for the points at which to cut them.

    ``by`` and ``tie`` are numeric columns. One pass looks for hot keys, a second for the cut
    points if there are any; without keys one pass does both.
    """
    parts = parts or part_count(df.sparkSession)
    if min_rows is None:
        min_rows = small_key_rows(df.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    cut_points = F.percentile_approx(by, shares, max(10_000, 20 * parts))
    found = None
    if not keys:
        n_rows, found = df.agg(F.count(F.lit(1)), cut_points).first()
        everything_hot, hot = n_rows > min_rows, None
    else:
        everything_hot, hot = False, hot_keys(df, keys, parts, min_rows)
    spread = tuple(spread) or tuple(df.columns)
    split = Split(tuple(keys), by, tie, hot, everything_hot, (), (), (), spread, parts)
    if not split.needed:
        return split
    rows = split.flagged(df.select(*keys, by, *([tie] if tie else []))).where("_hot")
    if keys:
        found = rows.agg(cut_points).first()[0]
    cuts = _cuts(found or [])
    points = tuple(_in_order(cuts))
    solid = tuple(point for point in points if cuts[point] > 1)
    ties: tuple[tuple[Point, ...], ...] = ()
    if solid and tie:
        most = max(cuts[point] for point in solid) + 1
        shares = [i / most for i in range(1, most)]
        found = (
            rows.where(F.array_contains(F.expr(_array(solid)), F.col(by)))
            .groupBy(by)
            .agg(F.percentile_approx(tie, shares, max(10_000, 20 * parts)).alias("cuts"))
            .orderBy(by)
            .collect()
        )
        # A value that fills n pieces needs n cuts, so all of them together stay below `parts`.
        own = {repr(point): count for point, count in cuts.items()}
        ties = tuple(_thinned(row["cuts"] or [], own[repr(row[by])] + 1) for row in found)
    return replace(split, points=points, solid=solid, ties=ties)
