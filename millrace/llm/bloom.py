"""Bloom filters of 64-bit keys that tasks ask, of bounded size.

A filter's bits are set slice by slice in tasks; only the finished filter, FILTER_BITS at most,
reaches the driver and is sent out with functions. More keys than it has room for make more
false hits, never misses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.words import mix

#: Bits of the filter for each key, in all at most, and of a slice of it; probes of a key.
BITS_EACH, FILTER_BITS, SLICE_BITS, PROBES = 16, 1 << 27, 1 << 19, 4


@dataclass
class Filter:
    """An empty filter holds nothing."""

    bits: np.ndarray

    def __len__(self) -> int:
        """Bytes of the filter."""
        return len(self.bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), len(self.bits) > 0)
        for place in probes(keys, len(self.bits) * 8) if len(self.bits) else ():
            found &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return found


def probes(keys: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield (mix(keys, 40 + k) & np.uint64(n_bits - 1)).astype(np.int64)


def filter_of(rows: DataFrame) -> Filter:
    """Of rows(key long); its size follows the number of rows up to FILTER_BITS."""
    n = rows.count()
    if not n:
        return Filter(np.zeros(0, dtype=np.uint8))
    n_bits = min(max(1 << (n * BITS_EACH - 1).bit_length(), 64), FILTER_BITS)
    slice_bits = min(SLICE_BITS, n_bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            place = np.unique(np.concatenate([*probes(keys, n_bits), np.zeros(0, dtype=np.int64)]))
            own, first = np.unique(place // slice_bits, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array([
                    (x % slice_bits).astype("<u4").tobytes() for x in np.split(place, first[1:])
                ][: len(own)], pa.binary())],
                ["part", "places"],
            )

    def merged(rows: pa.Table) -> pa.Table:
        bits = np.zeros(slice_bits // 8, dtype=np.uint8)
        for raw in rows.column("places"):
            place = np.frombuffer(raw.as_py(), dtype="<u4").astype(np.int64)
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        return pa.table({"part": rows.column("part")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    slices_of = (
        rows.select("key").mapInArrow(places, "part long, places binary")
        .groupBy("part").applyInArrow(merged, "part long, bits binary")
    )
    bits = np.zeros(n_bits // 8, dtype=np.uint8)
    for part, raw in slices_of.collect():
        bits[part * slice_bits // 8 :][: slice_bits // 8] = np.frombuffer(raw, dtype=np.uint8)
    return Filter(bits)
