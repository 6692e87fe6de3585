"""Grouping sets over a first, finest grouping; pivots; approximate distinct counts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates whose totals are no sums of their parts.
NOT_ADDING_UP = re.compile(
    r"\b(avg|mean|min|max|median|mode|first|last|any_value|percentile\w*|approx\w*|stddev\w*|std"
    r"|var\w*|corr|covar\w*|collect\w*|max_by|min_by)\b",
    re.IGNORECASE,
)


def grouping_totals(
    df: DataFrame,
    dims: Sequence[str],
    sets: str | Sequence[Sequence[str]],
    sums: Mapping[str, Column],
    flags: Mapping[str, str] | None = None,
) -> DataFrame:
    """Totals over ``rollup``, ``cube`` or the given grouping sets of the dimensions.

    ``sums`` names aggregates whose totals add up: sums and counts. Others raise a
    ValueError; distinct ones do not add up either, but their names do not tell them.

    Spark copies every input row once per grouping set. Sums of sums are sums, so the rows
    are first grouped by all dimensions and only those few groups are copied. ``flags`` names
    a column for ``grouping(dimension)``.
    """
    for name, total in sums.items():
        if NOT_ADDING_UP.search(str(total)):
            raise ValueError(f"totals of {name} do not add up: {total}")
    finest = df.groupBy(*dims).agg(*[total.alias(name) for name, total in sums.items()])
    if sets == "rollup":
        grouped = finest.rollup(*dims)
    elif sets == "cube":
        grouped = finest.cube(*dims)
    else:
        grouped = finest.groupingSets([[F.col(d) for d in one] for one in sets], *map(F.col, dims))
    marks = [F.grouping(dim).cast("int").alias(name) for name, dim in (flags or {}).items()]
    return grouped.agg(*[F.sum(name).alias(name) for name in sums], *marks)


def pivot_sums(
    df: DataFrame,
    rows: Sequence[str],
    across: str,
    values: Sequence[str],
    amount: Column,
    other: str = "other",
) -> DataFrame:
    """One column per listed value, and ``other`` for all the rest, NULL included."""
    listed = F.when(F.col(across).isin(*values), F.col(across)).otherwise(other)
    named = df.withColumn(across, listed)
    return named.groupBy(*rows).pivot(across, [*values, other]).agg(F.sum(amount))
