"""Token ids of whole texts, by encoding every distinct piece of a text once.

A text is cut where a character that is surely no white space meets ASCII white space, and
where a letter or digit meets a plain punctuation mark. The byte-level pattern of the
vocabulary only ever takes white space at the front of a token and never mixes letters or
digits with other marks (a contraction starts with its apostrophe, which is no place to cut),
so every such place is a boundary between tokens whatever stands around it, and the pieces'
tokens laid end to end are the text's own. The special string `<|endoftext|>` holds no such
place, so it lies inside one piece and the library treats it by its default.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from millrace.llm.words import span_hashes, text_bytes

#: Distinct pieces kept by a worker before it starts its store afresh; only memory depends on it.
PIECES_KEPT = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True

_MARK = np.zeros(256, dtype=bool)
_MARK[list(b",.;:!?*%&$#()[]{}=+/")] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at every text, at ASCII white space after a sure non-space, at marks.

    Unicode white space lies in U+0085, U+00A0 (lead byte C2) and in the ranges of lead bytes
    E1 to E3; a character with another lead byte is none. Below 0x80 only 0x21 to 0x7E count.
    """
    n = len(data)
    here = np.flatnonzero(_SPACE[data])
    here = here[here > 0]
    one = data[here - 1]
    two = data[np.maximum(here - 2, 0)]
    three = data[np.maximum(here - 3, 0)]
    sure = (one > 0x20) & (one < 0x7F)
    tail = one >= 0x80
    sure |= tail & (two >= 0xC3) & (two <= 0xDF)
    far = tail & (two >= 0x80) & (two < 0xC0)
    sure |= far & ((three >= 0xE4) | ((three >= 0x80) & (three < 0xC0)) | (three == 0xE0))
    mark = np.zeros(n + 1, dtype=bool)
    mark[here[sure]] = True
    mark[1:n] |= _MARK[data[1:]] & _ALNUM[data[:-1]]
    mark[offsets] = True
    mark[n] = False
    return np.flatnonzero(mark)


def grown(values: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """values with `more` from place `at`; the array doubles when it is full."""
    size = len(values)
    while at + len(more) > size:
        size *= 2
    if size > len(values):
        values = np.concatenate([values, np.zeros(size - len(values), dtype=values.dtype)])
    values[at : at + len(more)] = more
    return values


class Encoder:
    """Ids or counts of pieces, remembered between batches of one Python worker."""

    def __init__(self, path: str, keep_ids: bool):
        from tokenizers import Tokenizer

        # A task has one core; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.keep_ids = keep_ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.sizes = np.zeros(1024, dtype=np.int64)
        self.places = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number for every piece; sizes and ids are kept under it."""
        keys, at, inverse = np.unique(
            span_hashes(data, start, end, 0), return_index=True, return_inverse=True
        )
        if len(self.known) + len(keys) > PIECES_KEPT:
            self.forget()
        numbers = np.fromiter(
            (self.known.get(k, -1) for k in keys.tolist()), dtype=np.int64, count=len(keys)
        )
        new = np.flatnonzero(numbers < 0)
        raw = data.tobytes() if len(new) else b""
        for block in range(0, len(new), 4096):
            some = new[block : block + 4096]
            places = at[some]
            texts = [
                raw[s:e].decode("utf-8")
                for s, e in zip(start[places].tolist(), end[places].tolist(), strict=True)
            ]
            found = self.encode(texts)
            number = np.arange(len(self.known), len(self.known) + len(some))
            self.known.update(zip(keys[some].tolist(), number.tolist(), strict=True))
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.sizes = grown(self.sizes, number[0], sizes)
            if self.keep_ids:
                flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum()))
                self.places = grown(self.places, number[0], self.used + np.cumsum(sizes) - sizes)
                self.ids = grown(self.ids, self.used, flat)
                self.used += len(flat)
            numbers[some] = number
        return numbers[inverse]

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of every piece and the first piece of every text (one more at the end)."""
        data, offsets = text_bytes(column)
        start = cuts(data, offsets)
        end = np.append(start[1:], len(data)) if len(start) else start
        return self._numbers(data, start, end), np.searchsorted(start, offsets)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of every text."""
        numbers, first = self._pieces(column)
        sums = np.concatenate([[0], np.cumsum(self.sizes[numbers])])
        return sums[first[1:]] - sums[first[:-1]]

    def sequences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and where each text's start (one more at the end)."""
        numbers, first = self._pieces(column)
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.places[numbers] - (ends - sizes), sizes)
        ids = self.ids[shift + np.arange(len(shift))]
        return ids, np.concatenate([[0], ends])[first]


def encoder(path: str, keep_ids: bool) -> Encoder:
    """The Python worker's own encoder, kept from task to task.

    Functions of this package reach executors by value, so their modules' globals do not
    outlive a task; the store hangs on the library's module instead.
    """
    import tokenizers

    store = tokenizers.__dict__.setdefault("_encoders_of_worker", {})
    if (path, keep_ids) not in store:
        store[path, keep_ids] = Encoder(path, keep_ids)
    return store[path, keep_ids]
