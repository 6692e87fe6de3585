"""Token counts and packing against the tokenizer's own results."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from odd import docs, passage, texts
from tokenizers import Tokenizer

from millrace.llm.packing import pack
from millrace.llm.pieces import Encoder
from millrace.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a   b", "x  y  z\n\n q", "<|endoftext|> a <|endoftext|>", "é  é\t\tß", " ", "\n", "", "don't 's  stop\x1c x",
    "日本 語   x", "a\x85  b", "  lead", "😀 😀  x", "a,b 's.,x a.<|endoftext|>.b", "3.5% x'll.y", "　 　  .",
]


def ids_of(text: str) -> list[int]:
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts():
    import pyarrow as pa

    ids, first = Encoder(PATH, keep_ids=True).sequences(pa.array([*ODD, None]))
    for k, text in enumerate([*ODD, ""]):
        assert ids[first[k] : first[k + 1]].tolist() == ids_of(text)


@pytest.mark.parametrize("chunk,overlap", [(32_768, 256), (500, 20), (200, 2)])
def test_counts_with_chunks_of_any_size(spark, chunk, overlap):
    """Overlaps of two characters hold no boundary, so they are widened."""
    rows = [*enumerate(ODD), *texts(), (1000, "x" * 3000), (1001, passage(77, 900) + "y" * 2500 + " z")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = count_tokens(table, PATH, chunk, overlap).collect()
    expected = Counter((i, len((t or "").encode()), len(ids_of(t or ""))) for i, t in rows)
    assert Counter(map(tuple, found)) == expected


def test_packing_round_trip(spark):
    pieces = pack(docs(spark), PATH).collect()
    sizes, by_doc = Counter(), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        sizes[p.sequence_id] += p.length
        by_doc[p.doc_id].append(p)
    expected = defaultdict(list)
    for i, t in texts():
        expected[i].append([*ids_of(t or ""), 0])
    for i, wanted in expected.items():
        found = sorted(by_doc[i], key=lambda p: p.start)
        assert sum(p.length for p in found) == sum(map(len, wanted))
        if len(wanted) == 1:
            ids = np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in found]).tolist()
            assert ids == wanted[0] and {p.doc_tokens for p in found} == {len(ids)}
    for sequence, size in sizes.items():
        own = sorted((p for p in pieces if p.sequence_id == sequence), key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert size <= 1024 and (size == 1024 or size & (size - 1) == 0)


def test_empty_tables(spark):
    assert pack(docs(spark).limit(0), PATH).count() == 0
    assert count_tokens(docs(spark).limit(0), PATH).count() == 0


def test_digest_of_ids(spark):
    from pyspark.sql import functions as F

    found = pack(docs(spark), PATH).select("ids", "ids_crc32", F.crc32("ids").alias("c")).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.c == r.ids_crc32 for r in found)
    without = pack(docs(spark), PATH, with_ids=False).select("ids", "ids_crc32").collect()
    assert sorted(r.ids_crc32 for r in without) == sorted(r.ids_crc32 for r in found)
    assert {r.ids for r in without} == {None}
