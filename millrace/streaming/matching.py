"""Removing repeats from a stream and joining two streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.streaming.windows import on_event_time


def once_each(stream: DataFrame, ids: Sequence[str], at: str, delay: str) -> DataFrame:
    """Rows delivered again within the delay are dropped; state is kept no longer than that.

    Spark sends every row to the task that remembers its id. So that an id repeated very often
    does not swamp that task, repeats with the same time are dropped within each Arrow batch
    first.
    """
    same = [*ids, at]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats = batch.select(same).to_pandas().duplicated().to_numpy()
            yield batch.filter(pa.array(~repeats))

    thinned = stream.mapInArrow(thin, stream.schema)
    return on_event_time(thinned, at, delay).dropDuplicatesWithinWatermark(list(ids))


def stream_interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    before_seconds: int,
) -> DataFrame:
    """Pairs of one key with the right row at most ``before_seconds`` before the left one.

    Both streams carry watermarks, so that the time bound lets Spark forget rows which can
    find no partner any more. As in batch, a time bucket joins the key to spread a hot key. All
    pairs are the result: their number grows with the square of a key's rate.
    """
    width = F.lit(before_seconds + 1)
    latest = F.floor(F.unix_seconds(left_at) / width)
    earliest = F.floor((F.unix_seconds(left_at) - before_seconds - 1) / width)
    spans = F.array_distinct(F.sequence(earliest, latest))
    near_left = left.withColumn("_bucket", F.explode(spans))
    near_right = right.withColumn("_bucket", F.floor(F.unix_seconds(right_at) / width))
    reach = F.expr(f"INTERVAL {before_seconds} SECONDS")
    inside = (F.col(right_at) <= F.col(left_at)) & (F.col(right_at) >= F.col(left_at) - reach)
    same = F.lit(True)
    for key in [*keys, "_bucket"]:
        same = same & (near_left[key] == near_right[key])
    joined = near_left.join(near_right, same & inside)
    return joined.drop(*[near_right[key] for key in keys], near_left["_bucket"], near_right["_bucket"])
