"""Python functions that run on Arrow batches, for what built-in expressions do not cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf, pandas_udf


@pandas_udf(T.LongType())
def longest_run(values: pd.Series) -> pd.Series:
    """Length of the longest run of entries of one sign in each array."""

    present = values.notna().to_numpy()
    arrays = [array for array in values[present] if len(array)]
    lengths = np.array([0 if array is None else len(array) for array in values])
    longest = np.zeros(len(values), dtype=np.int64)
    if arrays:
        # All arrays of the batch are laid end to end and cut into runs at once.
        signs = np.sign(np.concatenate(arrays))
        starts = np.cumsum(lengths) - lengths
        new_run = np.concatenate(([True], np.diff(signs) != 0))
        new_run[starts[lengths > 0]] = True
        first = np.flatnonzero(new_run)
        owner = np.searchsorted(starts, first, side="right") - 1
        np.maximum.at(longest, owner, np.diff(np.append(first, len(signs))))
    return pd.Series(longest).where(present).astype("Int64")


@arrow_udtf(
    returnType=T.StructType()
    .add("id", T.LongType())
    .add("place", T.IntegerType())
    .add("word", T.StringType())
)
class WordsWithPlaces:
    """The words of each row's text with their places, counted from 1, a batch at a time.

    Takes a table of an id and a text.
    """

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        words = pc.utf8_split_whitespace(batch.column(1))
        owners = pc.list_parent_indices(words)
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        places = np.arange(len(owners)) - starts[owners.to_numpy()] + 1
        yield pa.table(
            {
                "id": batch.column(0).take(owners),
                "place": pa.array(places, pa.int32()),
                "word": pc.list_flatten(words),
            }
        )


def smoothed_daily(df: DataFrame, key: str, day: str, amount: str, weight: float) -> DataFrame:
    """Exponential smoothing of a daily series per key.

    Each value depends on the smoothed one before it, so a group is walked in order in
    Python. The groups hold one row per calendar day, however many rows the days had: the
    caller passes sums that Spark has already made.
    """

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(day)
        values = group[amount].ewm(alpha=weight, adjust=False).mean()
        return pd.DataFrame({key: group[key], day: group[day], "smoothed": values})

    schema = f"{key} string, {day} string, smoothed double"
    return df.select(key, day, F.col(amount).cast("double").alias(amount)).groupBy(
        key
    ).applyInPandas(smooth, schema)
