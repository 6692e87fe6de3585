"""Sum-of-squares packing of token sequences into windows.

Every task packs the rows of its own partition online. A document is its ids and one closing
id. Whole windows are cut from its front; the rest, shorter than a window, is placed into an
open window of that fill level which minimises the sum of squared counts of open windows per
level, or into a new window. One array holds the count per level, and each level a stack of its
open windows. When the partition ends, what lies in the open windows is cut and laid end to
end into full windows, and the last stretch into windows whose sizes are powers of two.

A task needs memory for the texts of one Arrow batch and for its open windows only. Nothing is
shuffled. Sequence numbers come from the partition and a running number, so a task that runs
again gives the same ones as long as its partition has the same rows in the same order, as
partitions of files do.

Defined results: a null or empty text gives the closing id alone; repeated rows are packed each
for itself; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import encoder
from millrace.llm.words import slices

WINDOW = 1024
CLOSING_ID = 0
#: Tokens of finished pieces that a task gathers before it hands them on.
HANDED_ON = 1 << 19
#: Bytes of text that are encoded at once; only memory and time depend on it.
BYTES_AT_ONCE = 4 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long"
)
_ARROW = pa.schema(
    [
        (name, pa.binary() if kind == "binary" else pa.int64())
        for name, kind in (part.split() for part in SCHEMA.split(","))
    ]
)


class Packer:
    """Open windows by fill level. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, first_sequence: int, with_ids: bool = True):
        self.window = window
        self.with_ids = with_ids
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.stacks: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.sequence = first_sequence
        self.done: list[tuple] = []
        self.tokens = 0

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            raw = ids.tobytes() if self.with_ids else None
            self.done.append(
                (doc_id, start, len(ids), raw, crc32(ids), doc_tokens, self.sequence, offset)
            )
            offset += len(ids)
        self.sequence += 1
        self.tokens += offset

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) whose use makes the sum of squares smallest."""
        top = self.window - size
        change = self.counts[size : self.window + 1] - self.counts[: top + 1]
        change = 2 * change + 2
        # Neither new windows nor full ones are counted; both ends have one term only.
        change[0] = 2 * self.counts[size] + 1
        if top > 0:
            change[top] = 1 - 2 * self.counts[top]
        unusable = self.counts[: top + 1] == 0
        unusable[0] = False
        change[unusable] = np.iinfo(np.int64).max
        # Among equals the fullest window.
        return top - int(np.argmin(change[::-1]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.window
        for start in range(0, whole, self.window):
            self.close([(doc_id, start, ids[start : start + self.window], n)])
        size = n - whole
        if not size:
            return
        level = self.level_for(size)
        if level:
            pieces = self.stacks[level].pop()
            self.counts[level] -= 1
        else:
            pieces = []
        # A copy, so that an open window does not hold on to the batch.
        pieces.append((doc_id, whole, ids[whole:].copy(), n))
        if level + size == self.window:
            self.close(pieces)
        else:
            self.stacks[level + size].append(pieces)
            self.counts[level + size] += 1

    def flush(self) -> None:
        left = [piece for stack in self.stacks for pieces in stack for piece in pieces]
        total = sum(len(piece[2]) for piece in left)
        sizes = [self.window] * (total // self.window)
        rest = total % self.window
        power = 1 << max(rest.bit_length() - 1, 0)
        while rest:
            if rest & power:
                sizes.append(power)
                rest -= power
            power >>= 1
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                doc_id, start, ids, n = left.pop()
                if len(ids) > size:
                    left.append((doc_id, start + size, ids[size:], n))
                    ids = ids[:size]
                pieces.append((doc_id, start, ids, n))
                size -= len(ids)
            self.close(pieces)

    def hand_on(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [[] for _ in _ARROW]
        self.done, self.tokens = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
        )


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """The pieces of docs(doc_id, text): (doc_id, start, length, ids, ids_crc32, doc_tokens,
    sequence_id, offset).

    ids are little-endian unsigned 32-bit numbers, null if with_ids is false; ids_crc32 is their
    CRC-32 in any case. tokenizer: path of a byte-level vocabulary file, the same on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(tokenizer, keep_ids=True)
        packer = Packer(window, TaskContext.get().partitionId() << 36, with_ids)
        for batch in (part for whole in batches for part in slices(whole, "text", BYTES_AT_ONCE)):
            ids, first = own.sequences(batch.column("text"))
            # Every text's ids, moved by the closing ids of those before it.
            closed = np.full(len(ids) + batch.num_rows, CLOSING_ID, dtype="<u4")
            closed[np.arange(len(ids)) + np.repeat(np.arange(batch.num_rows), np.diff(first))] = ids
            bounds = (first + np.arange(batch.num_rows + 1)).tolist()
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc_id, closed[bounds[k] : bounds[k + 1]])
                if packer.tokens > HANDED_ON:
                    yield packer.hand_on()
        packer.flush()
        yield packer.hand_on()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
