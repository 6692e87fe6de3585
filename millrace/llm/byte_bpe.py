"""Byte-level BPE of whole texts by a shuffle of their distinct words, and back.

Words are the matches of the vocabulary's pattern. Every task numbers the words of a block of
texts and sends each *once*, with its number, to the word's bucket. A bucket meets the words of
all blocks, so every distinct word is encoded once for the whole input, and its ids go back to
the blocks that asked for it. There the texts' word numbers, laid out in order of position, are
replaced by ids. How often a word occurs does not matter: a block sends a word that fills half
of its texts once, as any other, and rows of a bucket hold its words of one block together.

The number of buckets follows the input's partitions, so that a bucket stays bounded; a block
is BLOCK bytes of text or one longer text. Texts are read twice, once for the words and once
for the positions, which are never written. So the input must give the same rows in the same
partitions each time, as tables do: both readings carry a sum of the block's word hashes, and a
block whose sums differ ends the job with an error rather than with other words' ids.

Decoding joins ids with the token-byte table. That table is the vocabulary, whose size is fixed
and does not grow with the input, so each worker holds it and the join needs no shuffle.

Defined results: a null or empty text has no ids and decodes to no bytes; a null doc_id stays
null; repeated rows are repeated; ids that the vocabulary lacks, and null ids, decode to no bytes; only
doc_id and text are read, so other columns never clash; an empty table gives no rows. Words are
told apart by 64-bit hashes within a block and by their bytes everywhere else.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import cuts
from millrace.llm.words import slices, span_hashes, text_bytes

#: Bytes of text whose words are numbered together; only memory and traffic depend on it.
BLOCK = 4 << 20
#: Buckets for each partition of the input.
BUCKETS_PER_PARTITION = 16
#: Rows that are decoded at once; only memory depends on it.
ROWS = 1024
#: Words of a block that get the smallest numbers because they are frequent in it.
FREQUENT = 4096
#: No UTF-8 text holds this byte.
SEPARATOR = b"\xff"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file of lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _kept(name: str, make):
    """What the Python worker keeps from task to task under this name (see pieces.encoder)."""
    import tiktoken

    store = tiktoken.__dict__.setdefault("_kept_by_worker", {})
    if name not in store:
        store[name] = make()
    return store[name]


def _library(path: str, pattern: str):
    import tiktoken

    return _kept(f"library {path} {pattern}", lambda: tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={}
    ))


def _table(path: str) -> pa.Array:
    """The token-byte table: the bytes of every id, empty where the vocabulary has none and at the end."""

    def make() -> pa.Array:
        ranks = ranks_of(path)
        bytes_of = [b""] * (max(ranks.values(), default=-1) + 2)
        for token, rank in ranks.items():
            bytes_of[rank] = token
        return pa.array(bytes_of, pa.binary())

    return _kept(f"table {path}", make)


def expanded(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... sizes[0] of them, then those of the next, and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - sizes), sizes) + np.arange(total)


@dataclass
class BlockWords:
    """Distinct words of a block of texts in the order of their numbers, and where they stand."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    key: np.ndarray
    bucket: np.ndarray
    n_frequent: int
    #: Word numbers of all texts in order of position, and each text's first place (one more).
    sequence: np.ndarray
    first: np.ndarray

    @property
    def check(self) -> int:
        return int(self.key.sum(dtype=np.uint64).view(np.int64))


def numbered(column: pa.Array, pattern: str, buckets: int) -> BlockWords:
    """Texts are first cut at sure boundaries (see `pieces`); only distinct pieces that are not
    plainly one word meet the pattern."""
    import regex

    data, offsets = text_bytes(column)
    start = cuts(data, offsets)
    end = np.append(start[1:], len(data)) if len(start) else start
    _, at, inverse = np.unique(span_hashes(data, start, end, 0), return_index=True, return_inverse=True)
    low, high = start[at], end[at]
    others = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(~_LETTER[data], out=others[1:])
    blank = data[low] == 0x20 if len(low) else np.zeros(0, dtype=bool)
    plain = (others[high] == others[low + blank]) | (high - low == 1)
    odd = np.flatnonzero(~plain)
    find = regex.compile(pattern).findall
    parts = [
        [word.encode() for word in find(data[a:b].tobytes().decode())]
        for a, b in zip(low[odd].tolist(), high[odd].tolist(), strict=True)
    ]
    odd_words = [word for words in parts for word in words]
    # Words of odd pieces are appended to the block's bytes.
    odd_size = np.fromiter(map(len, odd_words), dtype=np.int64, count=len(odd_words))
    odd_start = len(data) + np.cumsum(odd_size) - odd_size
    data = np.concatenate([data, np.frombuffer(b"".join(odd_words), dtype=np.uint8)])
    word_start = np.concatenate([low[plain], odd_start])
    word_end = np.concatenate([high[plain], odd_start + odd_size])
    order = np.argsort(word_start, kind="stable")
    keys = np.empty(len(order), dtype=np.uint64)
    keys[order] = span_hashes(data, word_start[order], word_end[order], 0)
    key, word_at, number = np.unique(keys, return_index=True, return_inverse=True)
    # The words of every piece, in order.
    sizes = np.ones(len(at), dtype=np.int64)
    sizes[odd] = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    begins = np.cumsum(sizes) - sizes
    n_plain = int(plain.sum())
    words = np.empty(int(sizes.sum()), dtype=np.int64)
    words[begins[plain]] = number[:n_plain]
    words[expanded(begins[odd], sizes[odd])] = number[n_plain:]
    counts = sizes[inverse]
    sequence = words[expanded(begins[inverse], counts)]
    piece_first = np.concatenate([[0], np.cumsum(counts)])
    first = piece_first[np.searchsorted(start, offsets)]
    # Frequent words come first, so that most numbers are small; then by bucket.
    bucket = ((key >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    often = np.bincount(sequence, minlength=len(key))
    rare = np.ones(len(key), dtype=bool)
    rare[np.argsort(-often, kind="stable")[:FREQUENT]] = False
    order = np.lexsort((key, bucket, rare))
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.arange(len(key))
    spans = word_at[order]
    return BlockWords(
        data, word_start[spans], word_end[spans] - word_start[spans], key[order], bucket[order],
        int((~rare).sum()), rank[sequence], first,
    )


def blocks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", size):
            yield block, part
            block += 1


WORDS = "block long, bucket long, n_frequent int, words binary"
IDS = "block long, bucket long, n_frequent int, check long, sizes binary, ids binary"
PLACES = "block long, check long, doc_ids array<long>, lengths binary, sequence binary"


def _words(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, size: int):
    """A row for each block and bucket: the words, each ended by SEPARATOR, frequent ones first."""
    for block, part in blocks_of(batches, size):
        b = numbered(part.column("text"), pattern, buckets)
        n = len(b.size)
        order = np.lexsort((np.arange(n), b.bucket))
        start, length = b.start[order], b.size[order]
        ends = np.cumsum(length + 1)
        joined = np.full(int(ends[-1]) if n else 0, SEPARATOR[0], dtype=np.uint8)
        joined[expanded(ends - length - 1, length)] = b.data[expanded(start, length)]
        of = b.bucket[order]
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        frequent = np.concatenate([[0], np.cumsum(order < b.n_frequent)])
        tails = np.append(heads[1:], n)[: len(heads)]
        bounds = np.concatenate([[0], ends])[np.append(heads, n)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(joined)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(heads), block)), pa.array(of[heads]),
             pa.array(frequent[tails] - frequent[heads], pa.int32()), words],
            ["block", "bucket", "n_frequent", "words"],
        )


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, byte by byte and compressed."""
    width = 1 if not len(values) else max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T)
    head = len(values).to_bytes(8, "little") + bytes([width])
    return head + pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else head


def unpacked(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), raw[8]
    wide = np.zeros((n, 4), dtype=np.uint8)
    if n:
        planes = pa.decompress(raw[9:], n * width, codec="zstd", asbytes=True)
        wide[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
    return wide.view("<u4").ravel()


def _encoded(rows: pa.Table, path: str, pattern: str) -> pa.Table:
    """The ids of a bucket's words for every block; each distinct word is encoded once."""
    library = _library(path, pattern)
    known: dict[bytes, list[int]] = {}
    sizes, ids, checks = [], [], []
    for cell in rows.column("words"):
        words = cell.as_py()[:-1].split(SEPARATOR)
        found = []
        for word in words:
            own = known.get(word)
            if own is None:
                own = known[word] = library.encode_ordinary(word.decode())
            found.append(own)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for own in found for i in own), dtype=np.int64, count=int(lengths.sum()))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        keys = span_hashes(data, np.concatenate([[0], ends[:-1]]), ends, 0)
        checks.append(int(keys.sum(dtype=np.uint64).view(np.int64)))
        sizes.append(packed(lengths))
        ids.append(packed(flat))
    return pa.table(
        [rows.column("block"), rows.column("bucket"), rows.column("n_frequent"), pa.array(checks, pa.int64()),
         pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())],
        names=["block", "bucket", "n_frequent", "check", "sizes", "ids"],
    )


def _places(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, size: int):
    """A row for each block: its documents, their numbers of words, and all word numbers."""
    for block, part in blocks_of(batches, size):
        b = numbered(part.column("text"), pattern, buckets)
        doc_ids = part.column("doc_id")
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([b.check]),
             pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
             pa.array([packed(np.diff(b.first))], pa.binary()), pa.array([packed(b.sequence)], pa.binary())],
            ["block", "check", "doc_ids", "lengths", "sequence"],
        )


def _reassembled(places: pa.Table, ids: pa.Table) -> pa.Table:
    """(doc_id, ids) of one block's texts, by position."""
    empty = {"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))}
    if not places.num_rows:
        return pa.table(empty)
    ids = ids.sort_by("bucket")
    total = int(np.array(ids.column("check").to_pylist(), dtype=np.int64).view(np.uint64).sum(dtype=np.uint64))
    if total != places.column("check")[0].as_py() & ((1 << 64) - 1):
        raise RuntimeError("the texts' table gave other rows when it was read again; write it out first")
    cells = [
        (n, unpacked(s.as_py()).astype(np.int64), unpacked(i.as_py()))
        for n, s, i in zip(ids.column("n_frequent").to_pylist(), ids.column("sizes"), ids.column("ids"), strict=True)
    ]
    # Frequent words of all buckets have the first numbers, the others follow.
    sizes = [s[:n] for n, s, _ in cells] + [s[n:] for n, s, _ in cells]
    flat = [i[: s[:n].sum()] for n, s, i in cells] + [i[s[:n].sum() :] for n, s, i in cells]
    size = np.concatenate([*sizes, np.zeros(0, dtype=np.int64)])
    token = np.concatenate([*flat, np.zeros(0, dtype=np.uint32)]).astype(np.int32)
    start = np.cumsum(size) - size
    sequence = unpacked(places.column("sequence")[0].as_py())
    found = token[expanded(start[sequence], size[sequence])]
    ends = np.concatenate([[0], np.cumsum(size[sequence])])
    lengths = unpacked(places.column("lengths")[0].as_py()).astype(np.int64)
    bounds = ends[np.concatenate([[0], np.cumsum(lengths)])]
    doc_ids = places.column("doc_ids").combine_chunks()
    doc_ids = doc_ids.chunk(0) if isinstance(doc_ids, pa.ChunkedArray) else doc_ids
    return pa.table(
        {"doc_id": doc_ids.flatten(), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found))}
    )


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, block: int = BLOCK, buckets: int | None = None
) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs(doc_id, text), without special tokens.

    vocabulary: path of a file of ranks, the same on every machine; pattern: what splits words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if buckets is None:
        buckets = BUCKETS_PER_PARTITION * docs.rdd.getNumPartitions()
    given = {"pattern": pattern, "buckets": buckets, "size": block}
    ids = (
        docs.mapInArrow(partial(_words, **given), WORDS)
        .groupBy("bucket")
        .applyInArrow(partial_of(_encoded, vocabulary, pattern), IDS)
    )
    places = docs.mapInArrow(partial(_places, **given), PLACES)
    return (
        places.groupBy("block").cogroup(ids.groupBy("block"))
        .applyInArrow(_reassembled, "doc_id long, ids array<int>")
    )


def partial_of(function, *given):
    """With the last arguments given; Spark counts the parameters of a grouped function."""

    def run(rows: pa.Table) -> pa.Table:
        return function(rows, *given)

    return run


def joined(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The bytes of each list of ids by the token-byte table, whose last entry is empty."""
    number = ids.flatten().fill_null(-1).to_numpy()
    number = np.where((number < 0) | (number >= len(table)), len(table) - 1, number)
    found = table.take(pa.array(number))
    sizes = ids.value_lengths().fill_null(0).to_numpy()
    ends = np.frombuffer(found.buffers()[1], dtype=np.int32)[: len(found) + 1]
    bounds = ends[np.concatenate([[0], np.cumsum(sizes)])] if len(found) else np.zeros(len(ids) + 1, np.int32)
    bytes_of = found.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds.astype(np.int32)), bytes_of])


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded(doc_id, ids array<int>) with the bytes that the ids stand for, as `decoded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), ids, joined(ids, table)], ["doc_id", "ids", "decoded"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
