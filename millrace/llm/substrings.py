"""Removal of word windows that an earlier document has, behind a count-min prefilter.

A first pass merges the blocks' sketches (see `repeats`), a second one groups exactly the
windows whose estimate is two or more, by a 128-bit hash of their words. A block sends one row
per window it holds, with the smallest and the largest document it is in, so that a window of
very many documents gives one row per block. What comes back are the windows that start in a
smaller document than some of the block's, and the block marks the words they cover.

Defined results: words are runs of bytes other than space and 0x09 to 0x0D; a null or empty
text has none and stays as it is; a text with fewer words than a window is never changed; rows
with equal doc_id never remove each other's words; a row with a null doc_id is neither changed
nor counts as earlier; all given columns are kept, under reserved names the operator's win.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.repeats import Raised, blocks_of, carried, copied, live, raised_cells
from millrace.llm.words import Words, words_of

WINDOW = 13
#: Words of the runs whose smallest hash is a window's anchor.
ANCHOR = 5
BYTES_PER_ANCHOR = 30

CANDIDATES = "block long, h1 long, h2 long, low long, high long"


def window_anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window."""
    run = min(ANCHOR, window)
    place, value = words.windows(run, salt=1)
    n = len(words.start)
    full = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[place] = value
    at = words.windows(window)[0]
    least = full[at]
    for step in range(1, window - run + 1):
        np.minimum(least, full[at + step], out=least)
    return at, least


def _anchors(window: int):
    def anchors(texts: pa.ChunkedArray):
        words = words_of(texts.combine_chunks())
        at, value = window_anchors(words, window)
        edges = np.searchsorted(at, words.first)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield value[a:b]

    return anchors


def _candidates(window: int, cells: int):
    def find(docs: pa.Table, flags: pa.Table) -> pa.Table:
        kept = live(docs, flags)
        block = (docs if docs.num_rows else flags).column("block")[0].as_py()
        words = words_of(kept.column("text").combine_chunks(), hashes=2)
        at, value = window_anchors(words, window)
        pick = Raised(flags, cells)(value)
        h1 = words.windows(window, 0)[1][pick]
        h2 = words.windows(window, 1)[1][pick]
        ids = kept.column("doc_id").to_numpy()[words.owner[at[pick]]].astype(np.int64)
        order = np.argsort(h1, kind="stable")
        h1, h2, ids = h1[order], h2[order], ids[order]
        # Windows of one block with equal h1 but different h2 are kept apart by the second key.
        first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: len(h1)])
        return pa.table({
            "block": pa.array(np.full(len(first), block, dtype=np.int64)),
            "h1": h1[first].view(np.int64),
            "h2": h2[first].view(np.int64),
            "low": np.minimum.reduceat(ids, first) if len(first) else ids,
            "high": np.maximum.reduceat(ids, first) if len(first) else ids,
        })

    return find


def cut_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """A text without its removed words; a removed word takes the white space after it along."""
    stops = np.append(starts[1:], len(data))
    pieces = [data[: starts[0]].tobytes()] if len(starts) else [data.tobytes()]
    edges = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0, append=0))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        pieces.append(data[starts[a] : stops[b - 1]].tobytes())
    return b"".join(pieces)


def _removed(window: int):
    def remove(docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        n = docs.num_rows
        texts = docs.column("text").combine_chunks()
        words = words_of(texts)
        at, h1 = words.windows(window)
        known = verdicts.filter(pc.is_valid(verdicts.column("h1")))
        hashes = known.column("h1").to_numpy().view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes, least = hashes[order], known.column("least").to_numpy()[order]
        ids = docs.column("doc_id")
        numbers = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
        place = np.searchsorted(hashes, h1)
        place = np.minimum(place, max(len(hashes) - 1, 0))
        hit = np.zeros(len(h1), dtype=bool)
        if len(hashes):
            hit = (hashes[place] == h1) & (least[place] < numbers[words.owner[at]])
        pairs = copied(verdicts)
        rows = zip(ids.to_pylist(), docs.column("digest").to_pylist(), strict=True)
        is_copy = np.fromiter((r in pairs for r in rows), dtype=bool, count=n)
        hit |= is_copy[words.owner[at]]
        marks = np.zeros(len(words.start) + 1, dtype=np.int64)
        np.add.at(marks, at[hit], 1)
        np.add.at(marks, at[hit] + window, -1)
        gone = np.cumsum(marks)[:-1] > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_removed = sums[words.first[1:]] - sums[words.first[:-1]]
        out = texts.to_pylist()
        for i in np.flatnonzero(n_removed).tolist():
            a, b = words.first[i], words.first[i + 1]
            base, end = words.offsets[i], words.offsets[i + 1]
            out[i] = cut_text(
                words.data[base:end], words.start[a:b] - base, words.end[a:b] - base, ~gone[a:b]
            ).decode("utf-8")
        found = {c: docs.column(c) for c in ("doc_id", "text", "given")} | {
            "text": pa.array(out, pa.string()),
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
        }
        return pa.table(found)

    return remove


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) with text cut, and n_words (before) and n_removed added."""
    given, docs = carried(docs, ("n_words", "n_removed"))
    blocks = blocks_of(docs, BYTES_PER_ANCHOR)
    flags = raised_cells(blocks, _anchors(window))
    candidates = (
        blocks.docs.groupBy("block")
        .cogroup(flags.groupBy("block"))
        .applyInArrow(_candidates(window, blocks.cells), CANDIDATES)
    )
    nothing = F.lit(None)
    verdicts = (
        candidates.withColumn("least", F.min("low").over(Window.partitionBy("h1", "h2")))
        .where("least < high")
        .select(
            "block", "h1", "least", nothing.cast("long").alias("copy_id"),
            nothing.cast("string").alias("copied"),
        )
        .unionByName(blocks.copies.select(
            "block", nothing.cast("long").alias("h1"), nothing.cast("long").alias("least"),
            "copy_id", "copied",
        ))
    )
    kept = docs.schema.add("n_words", "long").add("n_removed", "long")
    return (
        blocks.docs.groupBy("block")
        .cogroup(verdicts.groupBy("block"))
        .applyInArrow(_removed(window), kept)
        .select("doc_id", "text", *given, "n_words", "n_removed")
    )
