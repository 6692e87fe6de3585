"""Removal of 50-byte strings that an earlier document has, by merging Burrows-Wheeler transforms.

Texts go through the prefilter of `repeats` first: a window's anchor is the smallest hash among
the shorter strings inside it, and neighbouring windows with one anchor form a *segment*. Equal
windows have equal anchors, so all segments of an anchor meet in one bucket, and no other bucket
needs them. Segments reach it once per block and content. An anchor in very many segments, as of
a phrase shorter than a window in a third of all texts, would bring them all into one bucket. Such
anchors are found in a sample of the texts first, which only chooses the path: each of their
windows is a segment of its own, and goes to a bucket by the 64-bit hash of its bytes, where equal
windows still meet.

In a bucket, a segment that is the only one of its anchor has no windows to share with another.
The rest are dealt into two shards. A shard sorts the places of its windows by their last
CONTEXT bytes once; with the byte before each place that is its transform, of bounded order. The
two transforms are then merged without sorting suffixes again (Holt and McMillan, 2014): the
interleave of the shards' rows by context is refined, once for each further byte of the window,
by a stable distribution of its rows by their transformed byte, each row going on to the one
before it. A row starts a new interval when its byte or its predecessor's interval differs, so
in the end the intervals are the windows with common 50-byte prefixes. Rows alone in their
interval share no such prefix with any other and leave early. An interval's smallest document is
the first in which its window starts. These go back to the blocks, which mark the bytes they
cover.

Defined results: a null text is an empty one; a text shorter than a window is never changed;
rows with equal doc_id never remove each other's bytes; a row with a null doc_id is neither
changed nor counts as earlier; other columns are kept, under reserved names the operator's win.
Removal may cut characters, so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bloom import Filter, filter_of
from millrace.llm.repeats import Raised, blocks_of, carried, copied, live, raised_cells
from millrace.llm.scratch import stored
from millrace.llm.words import BASES, _powers, mix, slices, text_bytes

WINDOW = 50
#: Bytes of the strings whose smallest hash is a window's anchor.
ANCHOR = 20
BYTES_PER_ANCHOR = 16
#: Windows of a segment, at most; longer ones go on in the next.
LONGEST = 200
#: An anchor in more segments than this goes by single windows; one in SAMPLED texts is looked at.
CROWDED, SAMPLED = 10_000, 64
#: Bytes by which a shard's rows are sorted.
CONTEXT = 8
#: Windows whose anchors are found at once; only memory and time depend on this.
STRETCH = 1 << 16

SEGMENTS = "block long, bucket long, anchor long, key long, bytes binary, low long, high long"
VERDICTS = "block long, key long, spans binary"


def byte_anchors(data: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window at every place of data (text edges not regarded)."""
    n = max(len(data) - window + 1, 0)
    out = np.empty(n, dtype=np.uint64)
    for low in range(0, n, STRETCH):
        high = min(low + STRETCH, n)
        out[low:high] = _anchors_at(data[low : high + window - 1], window)
    return out


def _anchors_at(data: np.ndarray, window: int) -> np.ndarray:
    gram = min(ANCHOR, window)
    sums = np.zeros(len(data) - gram + 1, dtype=np.uint64)
    done, step = 0, 1
    # Strings of `gram` bytes as polynomials, put together from powers of two of their length.
    part = data.astype(np.uint64)
    length, base = gram, BASES[0]
    while length:
        if length & 1:
            m = len(sums)
            sums = sums * np.uint64(pow(base, step, 1 << 64)) + part[done : done + m]
            done += step
        length >>= 1
        if length:
            part = part[:-step] * np.uint64(pow(base, step, 1 << 64)) + part[step:]
            step *= 2
    value = mix(sums, 3)
    width, have = window - gram + 1, 1
    least = value
    while have < width:
        more = min(have, width - have)
        least = np.minimum(least[: len(least) - more], least[more:])
        have += more
    return least


NONE = Filter(np.zeros(0, dtype=np.uint8))


def segments_of(column: pa.Array, window: int, crowded: Filter = NONE) -> tuple:
    """data, offsets, and of every segment: its text, first window, windows and anchor.

    crowded: of anchors whose windows are segments of their own.
    """
    data, offsets = text_bytes(column)
    anchors = byte_anchors(data, window)
    n = len(anchors)
    sizes = np.diff(offsets)
    valid = np.zeros(n + 1, dtype=np.int64)
    fits = sizes >= window
    np.add.at(valid, offsets[:-1][fits], 1)
    np.add.at(valid, np.minimum(offsets[1:][fits] - window + 1, n), -1)
    place = np.flatnonzero(np.cumsum(valid)[:n] > 0)
    value = anchors[place]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (place[1:] != place[:-1] + 1)
    starts_text = np.zeros(len(data) + 1, dtype=bool)
    starts_text[offsets] = True
    new |= starts_text[place]
    # Long runs are cut every LONGEST windows.
    run_start = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
    new |= (np.arange(len(place)) - run_start) % LONGEST == 0
    first = np.flatnonzero(new)
    if len(crowded):
        alone = np.repeat(crowded.holds(value[first]), np.diff(np.append(first, len(place))))
        first = np.flatnonzero(new | alone)
    count = np.diff(np.append(first, len(place)))
    begin = place[first]
    text = np.searchsorted(offsets, begin, side="right") - 1
    return data, offsets, text, begin, count, value[first]


def any_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of one block, which may overlap."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASES[1], n), out=sums[1:])
    value = (sums[end] - sums[start]) * _powers(pow(BASES[1], -1, 1 << 64), n + 1)[start]
    return mix(value ^ (end - start).astype(np.uint64), 6)


def _crowds(window: int):
    """Segments of a task by anchor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            anchors, times = np.unique(segments_of(batch.column("text"), window)[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.view(np.int64)), pa.array(times, pa.int64())], ["anchor", "n"]
            )

    return count


def crowded_anchors(docs: DataFrame, window: int, crowded: int, sampled: int) -> Filter:
    """The anchors that a sample shows in more than `crowded` segments.

    Their number grows with the input, the filter's size is bounded. A false hit sends another
    anchor's windows singly too, in every block alike.
    """
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(sampled)) == 0)
    found = (
        part.select(F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(_crowds(window), "anchor long, n long")
        .groupBy("anchor")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") * sampled > crowded)
        .select(F.col("anchor").alias("key"))
    )
    return filter_of(stored(found, "bytes-crowded"))


def _anchors(window: int):
    def anchors(texts: pa.ChunkedArray):
        _, _, text, _, _, value = segments_of(texts.combine_chunks(), window)
        edges = np.searchsorted(text, np.arange(len(texts) + 1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield value[a:b]

    return anchors


def _segments(window: int, cells: int, buckets: int, crowded: Filter):
    def find(docs: pa.Table, flags: pa.Table) -> pa.Table:
        kept = live(docs, flags)
        block = (docs if docs.num_rows else flags).column("block")[0].as_py()
        data, _, text, begin, count, anchor = segments_of(
            kept.column("text").combine_chunks(), window, crowded
        )
        pick = Raised(flags, cells)(anchor)
        text, begin, count, anchor = text[pick], begin[pick], count[pick], anchor[pick]
        end = begin + count + window - 1
        key = any_hashes(data, begin, end) if len(begin) else anchor
        ids = kept.column("doc_id").to_numpy()[text].astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, ids, anchor, begin, end = key[order], ids[order], anchor[order], begin[order], end[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        # A window of its own is known by its hash alone.
        own = crowded.holds(anchor)
        anchor = np.where(own, key, anchor)
        raw = data.tobytes()
        bounds = zip(begin[first].tolist(), np.where(own, begin, end)[first].tolist(), strict=True)
        return pa.table({
            "block": pa.array(np.full(len(first), block, dtype=np.int64)),
            "bucket": (mix(anchor[first], 8) % np.uint64(buckets)).astype(np.int64),
            "anchor": anchor[first].view(np.int64),
            "key": key[first].view(np.int64),
            "bytes": pa.array([raw[a:b] for a, b in bounds], pa.binary()),
            "low": np.minimum.reduceat(ids, first) if len(first) else ids,
            "high": np.maximum.reduceat(ids, first) if len(first) else ids,
        })

    return find


class Shard:
    """The places of a shard's windows, CONTEXT bytes before their ends, by the bytes there."""

    def __init__(self, data: np.ndarray, places: np.ndarray, context: int):
        key = np.zeros(len(places), dtype=np.uint64)
        for step in range(context):
            key = (key << np.uint64(8)) | data[places + step]
        order = np.argsort(key, kind="stable")
        self.places, self.key = places[order], key[order]


def merged(one: Shard, two: Shard, data: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, intervals of equal windows) of all windows that are not alone."""
    key = np.concatenate([one.key, two.key])
    order = np.argsort(key, kind="stable")  # two sorted runs: one merge
    places = np.concatenate([one.places, two.places])[order]
    key = key[order]
    new = np.ones(len(places), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    interval = np.cumsum(new, dtype=np.int32)
    for round_ in range(rounds + 1):
        alone = new & np.append(new[1:], True)
        if round_ == rounds or np.count_nonzero(alone) > len(alone) // 8:
            keep = ~alone
            places, interval = places[keep], interval[keep]
        if round_ == rounds or not len(places):
            break
        places = places - 1
        byte = data[places]
        order = np.argsort(byte, kind="stable")
        places, was, byte = places[order], interval[order], byte[order]
        new = np.ones(len(places), dtype=bool)
        new[1:] = (byte[1:] != byte[:-1]) | (was[1:] != was[:-1])
        interval = np.cumsum(new, dtype=np.int32)
    return places, interval


def first_documents(strings: list[bytes], low: np.ndarray, window: int) -> list[np.ndarray]:
    """For every window of each string the smallest document that has it."""
    context = min(CONTEXT, window)
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    begin = np.cumsum(lengths) - lengths
    count = np.maximum(lengths - window + 1, 0)
    edges = np.concatenate([[0], np.cumsum(count)])
    string = np.repeat(np.arange(len(strings)), count)
    start = begin[string] + np.arange(len(string)) - edges[string]
    half = int(edges[(len(strings) + 1) // 2])
    shards = [Shard(data, part + (window - context), context) for part in (start[:half], start[half:])]
    places, interval = merged(*shards, data, window - context)
    least = low[string]
    if len(places):
        number = np.zeros(len(data), dtype=np.int64)
        number[start] = np.arange(len(start))
        found = number[places]
        first = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
        smallest = np.minimum.reduceat(low[string[found]], first)
        least[found] = np.repeat(smallest, np.diff(np.append(first, len(found))))
    return [least[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def spans_of(least: np.ndarray) -> bytes:
    """Runs of equal values: (end, value) of each."""
    ends = np.append(np.flatnonzero(least[1:] != least[:-1]) + 1, len(least))
    return np.column_stack([ends, least[ends - 1]]).astype("<i8").tobytes()


def _judged(window: int):
    def judge(rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_numpy()
        unique, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        low = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(low, inverse, rows.column("low").to_numpy())
        content = rows.column("bytes").take(pa.array(at))
        windows = np.maximum(pc.binary_length(content).to_numpy() - window + 1, 1)
        _, alike, times = np.unique(
            rows.column("anchor").to_numpy()[at], return_inverse=True, return_counts=True
        )
        # What comes without bytes is one window, and its hash tells equal ones.
        several = np.flatnonzero((times[alike] > 1) & (pc.binary_length(content).to_numpy() > 0))
        single = np.column_stack([windows, low]).astype("<i8")
        spans = [row.tobytes() for row in single]
        most = low.copy()
        if len(several):
            strings = content.take(pa.array(several)).to_pylist()
            for k, least in zip(several.tolist(), first_documents(strings, low[several], window), strict=True):
                spans[k] = spans_of(least)
                most[k] = least.min()
        # Only to blocks that hold the segment in a later document.
        wanted = np.flatnonzero(most[inverse] < rows.column("high").to_numpy())
        return pa.table({
            "block": rows.column("block").take(pa.array(wanted)),
            "key": rows.column("key").take(pa.array(wanted)),
            "spans": pa.array([spans[k] for k in inverse[wanted].tolist()], pa.binary()),
        })

    return judge


def _removed(window: int, crowded: Filter):
    def remove(docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        texts = docs.column("text").combine_chunks()
        data, offsets, text, begin, count, _ = segments_of(texts, window, crowded)
        numbers = docs.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        known = verdicts.filter(pc.is_valid(verdicts.column("key")))
        keys = known.column("key").to_numpy().view(np.uint64)
        marks = np.zeros(len(data) + 1, dtype=np.int64)
        if len(keys) and len(begin):
            order = np.argsort(keys)
            keys = keys[order]
            raw = known.column("spans").take(pa.array(order)).to_pylist()
            spans = [np.frombuffer(s, dtype="<i8").reshape(-1, 2) for s in raw]
            sizes = np.array([len(s) for s in spans])
            firsts = np.cumsum(sizes) - sizes
            pairs = np.concatenate(spans)
            key = any_hashes(data, begin, begin + count + window - 1)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == key)
            n = sizes[at[hit]]
            segment = np.repeat(hit, n)
            index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row = firsts[at[segment]] + index
            stop = pairs[row, 0]
            start = np.where(index > 0, pairs[np.maximum(row - 1, 0), 0], 0)
            later = pairs[row, 1] < numbers[text[segment]]
            np.add.at(marks, begin[segment[later]] + start[later], 1)
            np.add.at(marks, begin[segment[later]] + stop[later] + window - 1, -1)
        pairs_of_copies = copied(verdicts)
        rows = zip(docs.column("doc_id").to_pylist(), docs.column("digest").to_pylist(), strict=True)
        is_copy = np.fromiter((r in pairs_of_copies for r in rows), dtype=bool, count=docs.num_rows)
        is_copy &= np.diff(offsets) >= window
        np.add.at(marks, offsets[:-1][is_copy], 1)
        np.add.at(marks, offsets[1:][is_copy], -1)
        gone = np.cumsum(marks)[:-1] > 0
        kept, removed, spans_found = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = gone[a:b]
            n = int(own.sum())
            removed.append(n)
            spans_found.append(int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum()) if n else 0)
            kept.append(data[a:b][~own].tobytes() if n else data[a:b].tobytes())
        found = {c: docs.column(c) for c in ("doc_id", "text", "given")} | {
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans_found, pa.int64()),
            "kept_bytes": pa.array(kept, pa.binary()),
        }
        return pa.table(found)

    return remove


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_bytes")


def remove_repeated_bytes(
    docs: DataFrame, window: int = WINDOW, crowded: int = CROWDED, sampled: int = SAMPLED
) -> DataFrame:
    """docs(doc_id, text, ...) with ADDED: kept_bytes is what is left of the text's bytes."""
    given, docs = carried(docs, ADDED)
    crowds = crowded_anchors(docs, window, crowded, sampled)
    blocks = blocks_of(docs, BYTES_PER_ANCHOR)
    flags = raised_cells(blocks, _anchors(window))
    segments = (
        blocks.docs.groupBy("block")
        .cogroup(flags.groupBy("block"))
        .applyInArrow(_segments(window, blocks.cells, blocks.count, crowds), SEGMENTS)
    )
    nothing = F.lit(None)
    verdicts = (
        segments.groupBy("bucket")
        .applyInArrow(_judged(window), VERDICTS)
        .withColumns({"copy_id": nothing.cast("long"), "copied": nothing.cast("string")})
        .unionByName(blocks.copies.select(
            "block", nothing.cast("long").alias("key"), nothing.cast("binary").alias("spans"),
            "copy_id", "copied",
        ))
    )
    kinds = docs.schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return (
        blocks.docs.groupBy("block")
        .cogroup(verdicts.groupBy("block"))
        .applyInArrow(_removed(window, crowds), kinds.add("kept_bytes", "binary"))
        .select("doc_id", "text", *given, *ADDED)
    )
