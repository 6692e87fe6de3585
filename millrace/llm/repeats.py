"""Which parts of the texts may repeat in another document: the shared first half of the
operators that remove repeats.

Documents are dealt into blocks of a few megabytes by a hash of their id. Every window of a
text has an *anchor*, the smallest hash among the short runs inside it. Equal windows have equal
anchors, and neighbouring windows mostly share theirs, so a text has few of them.

Count-min: every block counts the documents per anchor in a sketch of two rows of cells; only
non-zero cells are kept and sent, one list per block and slice of cells. The slices' owners add
the blocks' counts up and send back to each block which of *its* cells reached two. Collisions
only raise counts, so a window that is in two documents is always among those that a block
then finds with both cells raised. The sketch's width follows the size of the input and it is
never gathered or broadcast: each machine meets slices and blocks of a fixed size.

Copies of a whole text (by its md5 digest) are found first, so that only the first of a group
of copies goes through all this, however large the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mix

#: Bytes of text that a block holds on average; longer texts make larger blocks.
BLOCK_BYTES = 4 << 20
#: Cells of one slice of the sketch.
SLICE = 1 << 20
#: Cells of a row of the sketch for each anchor expected.
CELLS_PER_ANCHOR = 8
ROWS = 2

Anchors = Callable[[pa.ChunkedArray], Iterable[np.ndarray]]

CELLS = "block long, slice long, cells binary, several binary"


@dataclass
class Blocks:
    """docs: block, digest, doc_id, text and what else was given. copies: block, copy_id, copied
    (the digest) of the rows that repeat an earlier document's text. cells: cells of a row of the sketch.
    count: blocks."""

    docs: DataFrame
    copies: DataFrame
    cells: int
    count: int


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte, so that the empty upper bytes compress."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def carried(docs: DataFrame, added: tuple[str, ...]) -> tuple[list[str], DataFrame]:
    """How to take the other columns back, and docs as doc_id, text and a struct of those.

    Columns named as one of `added` are dropped; no other name can clash inside the struct.
    """
    own = {"doc_id", "text", *added}
    others = [c for c in docs.columns if c.lower() not in own]
    struct = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", struct.alias("given"))
    return [f"given.`{c}`" for c in others], slim


def blocks_of(docs: DataFrame, bytes_per_anchor: int, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """One pass over the texts measures them and makes their digests; the digests are kept."""
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(
        F.col("doc_id"), F.md5(text.cast("binary")).alias("digest"), F.octet_length(text).alias("n")
    ).checkpoint()
    total = keys.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    expected = CELLS_PER_ANCHOR * max(1, total // bytes_per_anchor)
    cells = max(SLICE, 1 << (expected - 1).bit_length())
    block = F.pmod(F.xxhash64("doc_id"), F.lit(count))
    firsts = (
        keys.where("doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .drop("last")
    )
    copies = (
        keys.join(firsts, "digest")
        .where("doc_id > first")
        .select(
            block.alias("block"), F.col("doc_id").alias("copy_id"), F.col("digest").alias("copied")
        )
        .distinct()
    )
    # At least as many partitions as the session's, at most one per block.
    parts = min(count, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 8))
    blocked = docs.select(block.alias("block"), F.md5(text.cast("binary")).alias("digest"), "*")
    return Blocks(blocked.repartition(parts, "block"), copies, cells, count)


def cells_of(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(anchors, 101 + row) & np.uint64(cells - 1)).astype(np.int64)


def copied(flags: pa.Table) -> set[tuple[int, str]]:
    """(doc_id, digest) of a block's copies."""
    pairs = zip(flags.column("copy_id").to_pylist(), flags.column("copied").to_pylist(), strict=True)
    return {pair for pair in pairs if pair[1] is not None}


def live(docs: pa.Table, flags: pa.Table) -> pa.Table:
    """The rows of a block that have an id and do not repeat an earlier document's text."""
    copies = copied(flags)
    ids = docs.column("doc_id").to_pylist()
    keep = [
        i is not None and (i, h) not in copies
        for i, h in zip(ids, docs.column("digest").to_pylist(), strict=True)
    ]
    return docs.filter(pa.array(keep, pa.bool_()))


def _counted(anchors: Anchors, cells: int):
    def count(docs: pa.Table, copies: pa.Table) -> pa.Table:
        block = (docs if docs.num_rows else copies).column("block")[0].as_py()
        kept = live(docs, copies)
        own = [np.unique(a) for a in anchors(kept.column("text"))] if kept.num_rows else []
        values = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
        out = {"block": [], "slice": [], "cells": [], "several": []}
        for row in range(ROWS):
            found, counts = np.unique(cells_of(values, row, cells), return_counts=True)
            parts = found // SLICE
            edges = np.flatnonzero(np.diff(parts, prepend=-1)).tolist() + [len(parts)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                low = found[a:b] % SLICE
                out["block"].append(block)
                out["slice"].append(row * (cells // SLICE) + int(parts[a]))
                out["cells"].append(packed(low))
                out["several"].append(packed(low[counts[a:b] > 1]))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return count


def _merge(lists: pa.Table) -> pa.Table:
    """Adds up one slice over the blocks and tells each block which of its cells reached two."""
    counts = np.zeros(SLICE, dtype=np.uint32)
    own = [unpacked(x) for x in lists.column("cells").to_pylist()]
    for cells, several in zip(own, lists.column("several").to_pylist(), strict=True):
        counts[cells] += 1
        counts[unpacked(several)] += 1
    raised = [packed(cells[counts[cells] > 1]) for cells in own]
    return pa.table(
        {
            "block": lists.column("block"),
            "slice": lists.column("slice"),
            "cells": pa.array(raised, pa.binary()),
        }
    )


def raised_cells(blocks: Blocks, anchors: Anchors) -> DataFrame:
    """For each block the raised cells of its own sketch, and its copies.

    Columns: block, slice, cells, copy_id, copied.
    """
    lists = (
        blocks.docs.groupBy("block")
        .cogroup(blocks.copies.groupBy("block"))
        .applyInArrow(_counted(anchors, blocks.cells), CELLS)
    )
    raised = lists.groupBy("slice").applyInArrow(_merge, "block long, slice long, cells binary")
    nothing = F.lit(None)
    return raised.select(
        "block", "slice", "cells", nothing.cast("long").alias("copy_id"),
        nothing.cast("string").alias("copied"),
    ).unionByName(blocks.copies.select(
        "block", nothing.cast("long").alias("slice"), nothing.cast("binary").alias("cells"),
        "copy_id", "copied",
    ))


class Raised:
    """Tells for anchors of a block whether both of their cells are raised."""

    def __init__(self, flags: pa.Table, cells: int):
        self.cells = cells
        self.rows: list[np.ndarray] = []
        per_row = cells // SLICE
        pairs = sorted(
            (s, raw)
            for s, raw in zip(
                flags.column("slice").to_pylist(), flags.column("cells").to_pylist(), strict=True
            )
            if s is not None
        )
        for row in range(ROWS):
            own = [
                unpacked(raw) + (s - row * per_row) * SLICE
                for s, raw in pairs
                if row * per_row <= s < (row + 1) * per_row
            ]
            self.rows.append(np.concatenate(own) if own else np.zeros(0, dtype=np.int64))

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        found = np.ones(len(anchors), dtype=bool)
        for row, raised in enumerate(self.rows):
            found &= among(cells_of(anchors, row, self.cells), raised)
        return found


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is one of the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values
