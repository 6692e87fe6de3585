"""Running totals and running bests over a key that may be too large for one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.segments import PLACE, Split, plan_split

SUM, BEST = "sum", "best"
_FOLD = {SUM: F.sum, BEST: F.max}


def running(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    folds: Mapping[str, tuple[str, Column]],
    spread: Sequence[str] = (),
    parts: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Adds, per key, the fold of all rows whose ``by`` is at or below the row's own.

    ``folds`` maps a new column name to ``("sum", column)`` or ``("best", column)``; the best
    is the maximum and may be a struct, compared field by field. Rows with equal ``by`` share
    one value, as in SQL's default frame. Sums should be of integers or decimals, whose
    totals do not depend on the order of addition.
    """
    folded = df.agg(*[_FOLD[kind](column).alias(name) for name, (kind, column) in folds.items()])
    types = {field.name: field.dataType for field in folded.schema}
    # Carried sums travel as inputs, so inputs are as wide as sums.
    inputs = {f"_in_{name}": column.cast(types[name]) for name, (_, column) in folds.items()}
    rows = df.withColumns(inputs)
    split = plan_split(rows, keys, by, spread=spread or df.columns, parts=parts, min_rows=min_rows)
    rows = split.tag(rows).withColumn("_lead", F.lit(0))
    if split.needed:
        rows = rows.unionByName(_lead_in(rows, split, folds), allowMissingColumns=True)
    window = split.window(F.desc("_lead"), F.col(by))
    local = {
        name: _FOLD[kind](f"_in_{name}").over(window).cast(types[name])
        for name, (kind, _) in folds.items()
    }
    return (
        rows.withColumns(local)
        .where("_lead = 0")
        .drop("_hot", "_solo", "_lead", *PLACE, *inputs)
    )


def _lead_in(rows: DataFrame, split: Split, folds: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """One row per segment holding the fold of what its rows follow.

    That is everything in earlier segments and, in a segment of one value, also the other
    subsegments, as all their rows are equals.
    """
    totals = (
        rows.where("_hot")
        .groupBy(*split.place, "_solo")
        .agg(*[_FOLD[kind](f"_in_{n}").alias(f"_own_{n}") for n, (kind, _) in folds.items()])
    )
    earlier = (
        Window.partitionBy(*split.keys)
        .orderBy("_seg")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    alike = Window.partitionBy(*split.keys, "_seg")
    lead = {}
    for name, (kind, _) in folds.items():
        own = F.col(f"_own_{name}")
        before = _FOLD[kind](own).over(earlier)
        whole = _FOLD[kind](own).over(alike)
        if kind == SUM:
            others = F.coalesce(whole, F.lit(0)) - F.coalesce(own, F.lit(0))
            nothing = before.isNull() & whole.isNull()
            peers = F.when(~nothing, F.coalesce(before, F.lit(0)) + others)
        else:
            peers = F.greatest(before, whole)
        value = F.when(F.col("_solo"), peers).otherwise(before)
        lead[f"_in_{name}"] = value.cast(rows.schema[f"_in_{name}"].dataType)
    return (
        totals.withColumns(lead)
        .drop(*[f"_own_{name}" for name in folds])
        .withColumns({"_hot": F.lit(True), "_lead": F.lit(1)})
    )
