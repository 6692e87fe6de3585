"""Event-time windows over streams; late rows count until the watermark passes them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_event_time(stream: DataFrame, at: str, delay: str) -> DataFrame:
    """The stream with a watermark; a timestamp without time zone gets the session's."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def stream_window_sums(
    stream: DataFrame,
    at: str,
    size: str,
    slide: str | None,
    keys: Sequence[str],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Tumbling (no ``slide``) or sliding sums; each map task adds up its rows first."""
    window = F.window(at, size, slide).alias("window")
    totals = [F.sum(column).alias(name) for name, column in sums.items()]
    grouped = stream.groupBy(window, *keys).agg(*totals)
    return grouped.select(F.col("window.start").alias("window_start"), *keys, *sums)


def stream_sessions(
    stream: DataFrame, at: str, gap: str, keys: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    session = F.session_window(at, gap).alias("session")
    totals = [F.sum(column).alias(name) for name, column in sums.items()]
    grouped = stream.groupBy(session, *keys).agg(*totals)
    return grouped.select(
        F.col("session.start").alias("start_at"), F.col("session.end").alias("end_at"), *keys, *sums
    )


# Adds up sessions within each map task before the shuffle, so that a hot key sends sessions
# rather than rows.
SESSION_CONF = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
