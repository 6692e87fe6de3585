"""Language-model scores from a log-frequency Bloom filter.

One- and two-token counts of all training texts are quantised to powers of LEVEL; a count of
level q is held as q members of a Bloom filter, and read back by asking for one level after the
other until one is missing. A false hit only raises a count; with BITS bits a member and PROBES
probes about one question in a hundred has one. Each token then has the smoothed probability
(c(h, w) + M p(w)) / (c(h) + M) with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), the counts c from
the filter. A text's history begins with a start symbol and its end is a token.

The filter grows with the corpus, so no worker holds all of it. It is cut into blocks: all
members of an n-gram lie in one, chosen by its hash, and the number of blocks follows the input.
Texts are taken in blocks as well. Each text block sends every distinct n-gram it has to the
n-gram's filter block, once, with its count in training texts. There the counts are summed, the
block's bits are set and asked for the n-grams of every text block, and the levels go back. Back
at the text block its tokens are scored. So the corpus is read twice whatever the filter's size,
and nothing but four sums reaches the driver. Exact one-token counts, which the base score
needs, go the same way.

Texts are read a second time for the scores, so the input must give the same rows in the same
partitions each time, as tables do; a text block that gets another number of answers than it
asks for ends the job with an error.

Defined results: a null or empty text has the end token alone; a null doc_id is scored but not
learned from; without training texts every token has probability 1; repeated rows are counted
and scored each; other columns are ignored. Tokens are told apart by 64-bit hashes, pairs within
a filter block by KEPT bytes of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import stored
from millrace.llm.words import mix, slices, text_bytes, words_of

#: Base of the quantised counts.
LEVEL = 1.5
#: Bits of a block per member, and probes per member.
BITS, PROBES = 10, 5
#: Bytes of text for each filter block.
BYTES_PER_BLOCK = 1 << 20
#: Weight of the one-token model, in tokens.
WEIGHT = 30.0
#: Bytes of text whose n-grams are asked for together; only memory and traffic depend on it.
TEXT_BLOCK = 4 << 20
#: Bytes of a pair's hash that are sent.
KEPT = 5

START, END = np.uint64(0x51A27), np.uint64(0xE4D)


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, the token before it, text) of all tokens of a batch, end tokens included."""
    words = words_of(column, lower=True)
    n = np.diff(words.first) + 1
    ends = np.cumsum(n) - 1
    token = np.full(int(n.sum()), END, dtype=np.uint64)
    place = np.ones(len(token), dtype=bool)
    place[ends] = False
    token[place] = words.keys[0]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - n + 1] = START
    return token, before, np.repeat(np.arange(len(n)), n)


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9FB21C651E98DF25) + token, 5)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(keys, 9) % np.uint64(blocks)).astype(np.int64)


def grams_of(column: pa.Array, blocks: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The text of every token, and for tokens and pairs: the distinct keys in order of filter
    block and key, their blocks, and each token's place among them. The last token stands for
    START."""
    token, before, text = sequences(column)
    out = []
    for own in (np.append(token, START), pair_key(before, token)):
        keys, inverse = np.unique(own, return_inverse=True)
        block = block_of(keys, blocks)
        order = np.lexsort((keys, block))
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        out.append((keys[order], block[order], place[inverse]))
    return text, out


def levels_of(counts: np.ndarray) -> np.ndarray:
    """0 for a count of 0, else 1 and up."""
    return np.where(counts > 0, np.floor(np.log(np.maximum(counts, 1)) / np.log(LEVEL) + 1e-9) + 1, 0).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    middle = (LEVEL ** (level - 1.0) + np.maximum(LEVEL**level - 1.0, 1)) / 2
    return np.where(level > 1, middle, level)


def probes(keys: np.ndarray, level: np.ndarray | int, bits: int) -> Iterator[np.ndarray]:
    """Places of a member's bits within its block."""
    one = mix(keys ^ (np.asarray(level, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)), 31)
    two = (one << np.uint64(32)) | np.uint64(1 << 31)
    for _ in range(PROBES):
        # The upper half of a number, scaled to the block.
        yield (((one >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)
        one = one + two


def built(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of a block that holds these n-grams with their counts, one in each byte."""
    levels = levels_of(counts)
    members = np.repeat(keys, levels)
    level = np.arange(len(members)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    bits = np.zeros(max(BITS * len(members), 8), dtype=bool)
    for places in probes(members, level, len(bits)):
        bits[places] = True
    return bits


def asked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key, by asking for one level after the other until one is missing."""
    found = np.zeros(len(keys), dtype=np.int64)
    left = np.arange(len(keys))
    level = 0
    while len(left):
        level += 1
        hit = np.ones(len(left), dtype=bool)
        for places in probes(keys[left], level, len(bits)):
            hit &= bits[places]
        left = left[hit]
        found[left] = level
    return found


def squeezed(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of whole numbers, byte by byte and compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def spread(raw: bytes, n: int, width: int) -> np.ndarray:
    wide = np.zeros((n, 8), dtype=np.uint8)
    planes = pa.decompress(raw, n * width, codec="zstd", asbytes=True)
    wide[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
    return wide.view("<u8").ravel()


#: kind 0: tokens, with whole keys, kind 1: pairs, with KEPT bytes of theirs.
QUESTIONS = "block long, text_block long, kind int, n int, keys binary, counts binary"
#: levels: one byte each; counts: exact, of tokens only; tokens and distinct: of training texts,
#: with the first row of a filter block.
ANSWERS = "text_block long, block long, kind int, n int, levels binary, counts binary, tokens long, distinct long"
TEXTS = "text_block long, doc_ids array<long>, sizes binary, n_bytes long, bytes binary"
SCORES = (
    "doc_id long, n_tokens long, n_known long, base_score double, score double"
)
WIDTHS = (8, KEPT)


def text_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "text", size):
            yield number, batch
            number += 1


def _questions(blocks: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in text_blocks(batches, size):
            learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(np.int64)
            text, grams = grams_of(batch.column("text"), blocks)
            rows: dict[str, list] = {part.split()[0]: [] for part in QUESTIONS.split(", ")}
            for kind, (keys, block, place) in enumerate(grams):
                weights = learned[text]
                if kind == 0:
                    weights = np.append(weights, learned.sum())
                counts = np.bincount(place, weights=weights, minlength=len(keys)).astype(np.int64)
                heads = np.flatnonzero(np.diff(block, prepend=-1))
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True):
                    values = (block[a], number, kind, b - a, squeezed(keys[a:b], WIDTHS[kind]), squeezed(counts[a:b], 4))
                    for name, value in zip(rows, values, strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[name], kind) for name, kind in zip(
                    rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                list(rows),
            )

    return run


def _answers(rows: pa.Table) -> pa.Table:
    """A filter block's levels for the n-grams of every text block."""
    kinds, sizes = rows.column("kind").to_numpy(), rows.column("n").to_numpy()
    raw_keys, raw_counts = rows.column("keys").to_pylist(), rows.column("counts").to_pylist()
    levels, exact = [b""] * len(kinds), [None] * len(kinds)
    tokens = distinct = 0
    for kind in (0, 1):
        own = np.flatnonzero(kinds == kind).tolist()
        if not own:
            continue
        keys = np.concatenate([spread(raw_keys[k], int(sizes[k]), WIDTHS[kind]) for k in own])
        counts = np.concatenate([spread(raw_counts[k], int(sizes[k]), 4).astype(np.int64) for k in own])
        known, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, weights=counts, minlength=len(known)).astype(np.int64)
        found = asked(built(known, sums), known)
        if kind == 0:
            words = known != START
            tokens, distinct = int(sums[words].sum()), int((sums[words] > 0).sum())
        done = 0
        for k in own:
            part = at[done : done + int(sizes[k])]
            levels[k] = squeezed(found[part], 1)
            if kind == 0:
                exact[k] = squeezed(sums[part], 8)
            done += int(sizes[k])
    first = np.arange(len(kinds)) == 0
    return pa.table(
        [rows.column("text_block"), rows.column("block"), rows.column("kind"), rows.column("n"),
         pa.array(levels, pa.binary()), pa.array(exact, pa.binary()),
         pa.array(np.where(first, tokens, 0)), pa.array(np.where(first, distinct, 0))],
        names=[part.split()[0] for part in ANSWERS.split(", ")],
    )


def _texts(size: int):
    """A row for each text block: its documents and their texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in text_blocks(batches, size):
            data, offsets = text_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                 pa.array([squeezed(np.diff(offsets), 8)], pa.binary()), pa.array([len(data)]),
                 pa.array([pa.compress(data.tobytes(), codec="zstd", asbytes=True)], pa.binary())],
                ["text_block", "doc_ids", "sizes", "n_bytes", "bytes"],
            )

    return run


def _scored(blocks: int, n_train: int, n_distinct: int):
    total = n_train + 0.1 * (n_distinct + 1)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(),) * 3 + (pa.float64(),) * 2],
                            names=[part.split()[0] for part in SCORES.split(", ")])
        doc_ids = texts.column("doc_ids").combine_chunks().flatten()
        n = len(doc_ids)
        size = texts.column("n_bytes")[0].as_py()
        data = pa.decompress(texts.column("bytes")[0].as_py(), size, codec="zstd")
        sizes = spread(texts.column("sizes")[0].as_py(), n, 8).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), data])
        text, ((keys, _, place), (pair_keys, _, pair_place)) = grams_of(column, blocks)
        answers = answers.sort_by([("kind", "ascending"), ("block", "ascending")])
        kinds, ns = answers.column("kind").to_pylist(), answers.column("n").to_pylist()
        got: list[list[np.ndarray]] = [[], []]
        exact = []
        for kind, m, levels, counts in zip(
            kinds, ns, answers.column("levels").to_pylist(), answers.column("counts").to_pylist(), strict=True
        ):
            got[kind].append(spread(levels, m, 1).astype(np.int64))
            if kind == 0:
                exact.append(spread(counts, m, 8).astype(np.int64))
        one, both = (count_of(np.concatenate([*part, np.zeros(0, dtype=np.int64)])) for part in got)
        exact = np.concatenate([*exact, np.zeros(0, dtype=np.int64)])
        if len(one) != len(keys) or len(both) != len(pair_keys):
            raise RuntimeError("the texts' table gave other rows when it was read again; write it out first")
        at = place[:-1]
        # A token's history is the token before it, and START at the front of a text.
        before = np.append(place[-1:], at[:-1])
        before[np.flatnonzero(np.diff(text, prepend=-1))] = place[-1]
        history = one[before]
        p_one = (one[at] + 0.1) / total
        p = (np.minimum(both[pair_place], history) + WEIGHT * p_one) / (history + WEIGHT)
        base = np.log10((exact[at] + 0.1) / total)
        return pa.table({
            "doc_id": doc_ids,
            "n_tokens": pa.array(np.bincount(text, minlength=n)),
            "n_known": pa.array(np.bincount(text, weights=exact[at] > 0, minlength=n).astype(np.int64)),
            "base_score": pa.array(np.bincount(text, weights=base, minlength=n)),
            "score": pa.array(np.bincount(text, weights=np.log10(p), minlength=n)),
        })

    return run


def score_texts(
    docs: DataFrame, training: Column, bytes_per_block: int = BYTES_PER_BLOCK, text_block: int = TEXT_BLOCK
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    training: a condition on docs(doc_id, text); rows where it is true are learned from.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("learned")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, size // bytes_per_block)
    answers = stored(
        rows.mapInArrow(_questions(blocks, text_block), QUESTIONS).groupBy("block").applyInArrow(_answers, ANSWERS),
        "lm-answers",
    )
    n_train, n_distinct = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct")]).first()
    scores = (
        rows.mapInArrow(_texts(text_block), TEXTS).groupBy("text_block")
        .cogroup(answers.drop("tokens", "distinct").groupBy("text_block"))
        .applyInArrow(_scored(blocks, n_train, n_distinct), SCORES)
    )
    return scores.select(
        "doc_id", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score"
    )
