"""A stateful stream operator of our own: the largest values per key and day.

Spark has no ranking in streams. The state of a key holds the k largest rows so far of each
day that the watermark has not passed, so its size depends on neither the number of rows nor
the age of the stream. Days are kept inside the state rather than made part of the key
because every key costs a call into Python, and a timer, per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_SECONDS = 86_400

_STATE = (
    T.StructType()
    .add("days", T.ArrayType(T.LongType()))
    .add("falling", T.ArrayType(T.LongType()))
    .add("ids", T.ArrayType(T.LongType()))
)
_OUT = (
    T.StructType()
    .add("key", T.LongType())
    .add("day", T.LongType())
    .add("place", T.IntegerType())
    .add("id", T.LongType())
    .add("amount", T.LongType())
)


def _preselect(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Keeps the k largest rows of each key and day within a batch, before the shuffle.

    ``latest`` is the newest time in the batch, kept so that the watermark moves as if no row
    had been left out.
    """

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ordered = batch.sort_values(["amount", "id"], ascending=[False, True])
                kept = ordered.groupby(["key", "day"], dropna=False).head(k)
                yield kept.assign(latest=batch["latest"].max())

    return select


def _keep_largest(k: int) -> Callable:
    """Folds new rows into the state; on time-out sends on the days that are over.

    Its helpers are nested so that they travel to the executors with it: those need not have
    this package.
    """

    def closes_ms(day: int) -> int:
        return (day + 1) * DAY_SECONDS * 1000

    def remember(state: GroupState, best: list[tuple[int, int, int]]) -> None:
        if not best:
            state.remove()
            return
        state.update(tuple(list(column) for column in zip(*best, strict=True)))
        # A timer goes off once the watermark is beyond it, here once it reaches the day's end.
        state.setTimeoutTimestamp(closes_ms(best[0][0]) - 1)

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        best = sorted(zip(*state.get, strict=True)) if state.exists else []
        watermark_ms = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            done = [entry for entry in best if closes_ms(entry[0]) <= watermark_ms]
            remember(state, best[len(done) :])
            sent = [
                (key[0], day, place, row_id, -falling)
                for day, rows_of_day in groupby(done, key=itemgetter(0))
                for place, (_, falling, row_id) in enumerate(rows_of_day, start=1)
            ]
            yield pd.DataFrame(sent, columns=_OUT.fieldNames())
            return
        for batch in batches:
            rows = zip(
                batch["day"].tolist(),
                (-batch["amount"]).tolist(),
                batch["id"].tolist(),
                strict=True,
            )
            # Rows of a day that has been sent on already are late.
            best.extend(row for row in rows if closes_ms(row[0]) > watermark_ms)
            by_day = groupby(sorted(best), key=itemgetter(0))
            best = [row for _, rows_of_day in by_day for row in islice(rows_of_day, k)]
        if best:
            remember(state, best)

    return step


def largest_of_day(
    stream: DataFrame, key: str, at: str, row_id: str, amount: str, k: int, delay: str
) -> DataFrame:
    """The k largest ``amount`` rows of each key and day (in UTC), once the day is over.

    ``key``, ``row_id`` and ``amount`` are longs; a row comes once. Days count from
    1970-01-01.
    """
    moment = F.col(at).cast("timestamp")
    rows = stream.select(
        F.col(key).cast("long").alias("key"),
        F.floor(F.unix_seconds(moment) / DAY_SECONDS).alias("day"),
        F.col(row_id).alias("id"),
        F.col(amount).alias("amount"),
        moment.alias("latest"),
    )
    selected = rows.mapInPandas(_preselect(k), rows.schema).withWatermark("latest", delay)
    return selected.groupBy("key").applyInPandasWithState(
        _keep_largest(k), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
