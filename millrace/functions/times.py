"""Time as whole microseconds, so that it can be cut, bucketed and subtracted exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp column.

    A timestamp without time zone is measured on its own clock, never through the session
    time zone, so no hour is skipped or doubled there.
    """
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(name)
    since = F.col(name) - F.expr("timestamp_ntz '1970-01-01'")

    def part(field: str) -> Column:
        return F.date_part(F.lit(field), since)

    hours = part("DAY").cast("long") * 24 + part("HOUR")
    seconds = (hours * 60 + part("MINUTE")) * 60
    return seconds * SECOND + (part("SECOND") * SECOND).cast("long")
