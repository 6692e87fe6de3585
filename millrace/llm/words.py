"""Words of whole texts as numpy arrays, for functions that run on Arrow batches.

A batch of texts is one run of UTF-8 bytes. Words are the maximal runs of bytes other than
space and 0x09 to 0x0D; none of those bytes occurs inside a longer UTF-8 character, so cutting
bytes cuts whole characters. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multipliers, so that they have inverses modulo 2**64; fixed values of this library.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scrambles 64-bit values one to one (the finaliser of splitmix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64, by doubling; kept for the task."""
    out = _POWERS.get(base, np.ones(1, dtype=np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    _POWERS[base] = out
    return out[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts laid end to end, and where each text starts (one more at the end)."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if buffers[2] is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: text i has words first[i] to first[i + 1] - 1.

    start and end are byte places in data; keys holds one or two independent 64-bit hashes.
    """

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    keys: list[np.ndarray]

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int, which: int = 0, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of every run of `size` words that lies within one text."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        base = pow(BASES[which], 2 * salt + 3, 1 << 64)
        key = self.keys[which]
        total = key[: n - size + 1].copy()
        for step in range(1, size):
            total *= np.uint64(base)
            total += key[step : n - size + 1 + step]
        ends = np.repeat(self.first[1:], np.diff(self.first))[: n - size + 1]
        place = np.flatnonzero(np.arange(n - size + 1) + size <= ends)
        return place, mix(total[place], which + 7 * salt)


def words_of(column: pa.Array, lower: bool = False, hashes: int = 1) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    n = len(data)
    # A word starts at a non-space that follows a space or the beginning of a text.
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(n, dtype=bool)
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.ones(n, dtype=bool)
    after[:-1] = space[1:]
    after |= edge[1:]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    first = np.searchsorted(start, offsets)
    keys = []
    for which in range(hashes):
        keys.append(span_hashes(data, start, end, which))
    return Words(data, offsets, start, end, first, keys)


#: Bytes that are hashed at once; only the memory for it depends on this.
STRETCH = 1 << 18


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running sums modulo 2**64.

    Spans are in order and do not overlap.
    """
    base = BASES[which]
    out = np.zeros(len(start), dtype=np.uint64)
    powers = inverse = np.ones(1, dtype=np.uint64)
    done = 0
    while done < len(start):
        begin = start[done]
        stop = max(int(np.searchsorted(end, begin + STRETCH, side="right")), done + 1)
        n = int(end[stop - 1] - begin)
        if n + 1 > len(powers):
            powers = _powers(base, n + 1)
            inverse = _powers(pow(base, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        part = data[begin : begin + n].astype(np.uint64)
        part += np.uint64(1)
        part *= powers[:n]
        np.cumsum(part, out=sums[1:])
        first, last = start[done:stop] - begin, end[done:stop] - begin
        # Every span is moved to the same power, so that equal bytes give equal values anywhere.
        out[done:stop] = (sums[last] - sums[first]) * inverse[first]
        done = stop
    return mix(out ^ (end - start).astype(np.uint64), which)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text each, or one longer text."""
    offsets = text_bytes(batch.column(column))[1]
    done = 0
    while done < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[done] + most, side="right")) - 1
        stop = max(stop, done + 1)
        yield batch.slice(done, stop - done)
        done = stop
