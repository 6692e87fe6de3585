"""Exact sums of money in whole units, the same in whatever order tasks finish.

Decimal sums would be exact too, but their wide buffers leave the fast path. Here amounts are
longs, and a sum is kept as two longs (the high bits and the low bits of each amount), so it
cannot overflow before some 10^12 rows of the largest amounts; the two meet in a decimal at
the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_BITS = 20


def cents(name: str) -> Column:
    return F.rint(F.col(name) * 100).cast("long")


def net_units() -> Column:
    """A line's price after discount in hundredths of a cent."""
    return cents("l_extendedprice") * (F.lit(100) - cents("l_discount"))


def limb_sums(units: Column, name: str) -> list[Column]:
    """The two sums that together hold an exact total; sums of them hold totals of totals."""
    low = units.bitwiseAND((1 << LOW_BITS) - 1)
    return [
        F.sum(F.shiftright(units, LOW_BITS)).alias(f"{name}_high"),
        F.sum(low).alias(f"{name}_low"),
    ]


def total_of(high: Column, low: Column) -> Column:
    """The total held by two limb sums, as a decimal without fraction."""
    return high.cast("decimal(20,0)") * F.lit(1 << LOW_BITS) + low.cast("decimal(20,0)")


def exact_sum(units: Column) -> Column:
    """The sum of a long column as a decimal without fraction."""
    high, low = limb_sums(units, "_")
    return total_of(high, low)


def amount(total: Column, digits: int) -> Column:
    """A total of units as a plain amount."""
    return total.cast("double") / 10**digits
