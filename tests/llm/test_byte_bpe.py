"""Ids and decoded bytes against the library's own, text by text."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from odd import docs, passage, texts
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import decode, encode, joined, numbered, packed, ranks_of, unpacked
from millrace.llm.queries.tokens import op13_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(PATH), special_tokens={})
ODD = [
    "a   b", "x  y  z\n\n q", "<|endoftext|> a <|endoftext|>", "é  é\t\tß", " ", "\n", "", "don't 's  stop\x1c x",
    "日本 語   x", "a\x85  b", "  lead", "😀 😀  x", "a,b 's.,x a.<|endoftext|>.b", "3.5% x'll.y", "　 　  .",
    "we'Re it's×÷é l’été", "\x00\x01 \x00", "x" * 5000, " \r\n \r\n", "1234 ½ ²", None,
]


def ids_of(text: str | None) -> list[int]:
    return LIBRARY.encode_ordinary(text or "")


@pytest.mark.parametrize("block,buckets", [(8 << 20, None), (300, 3), (1, 1)])
def test_ids_and_bytes_are_the_librarys(spark, block, buckets):
    rows = [*enumerate(ODD), *texts(), (1000, passage(77, 9000) + "y" * 2500 + " z")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    found = decode(encode(table, PATH, PATTERN, block, buckets), PATH).collect()
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found)
    assert got == Counter((i, tuple(ids_of(t)), (t or "").encode()) for i, t in rows)


def test_query_on_clashing_columns_and_empty_tables(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op13_byte_bpe(spark, str(tmp_path)).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len(ids_of(t))) for i, t in texts())
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    wanted = Counter(map(tuple, whole.select("doc_id", text).collect()))
    assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == wanted
    assert encode(whole.limit(0), PATH, PATTERN).count() == 0


def test_a_word_is_sent_once_by_a_block_whatever_its_count():
    b = numbered(pa.array(["same word " * 5000, None, "same"]), PATTERN, 7)
    words = {b.data[s : s + n].tobytes() for s, n in zip(b.start, b.size, strict=True)}
    assert words == {b"same", b" same", b" word", b" "} and len(b.sequence) == 10_002
    assert b.first.tolist() == [0, 10_001, 10_001, 10_002]


def test_decoding_unknown_ids_gives_no_bytes():
    table = pa.array([b"a", b"bc", b""], pa.binary())
    lists = pa.array([[0, 1, 7, -1, None, 1], [], None, [1]], pa.list_(pa.int32()))
    assert joined(lists, table).to_pylist() == [b"abcbc", b"", b"", b"bc"]
    assert joined(pa.array([], pa.list_(pa.int32())), table).to_pylist() == []
    assert joined(lists[1:3], table).to_pylist() == [b"", b""]


def test_numbers_survive_packing():
    import numpy as np

    for values in ([], [0], [0, 255], [65_536, 3], [1 << 31, 5]):
        assert unpacked(packed(np.array(values, dtype=np.int64))).tolist() == values


def test_a_table_that_changes_between_readings_is_an_error(spark):
    def other(batches):
        import os

        for batch in batches:
            text = pa.array([os.urandom(8).hex() for _ in range(batch.num_rows)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), text], ["doc_id", "text"])

    table = spark.range(200).mapInArrow(other, "doc_id long, text string")
    with pytest.raises(Exception, match="other rows"):
        encode(table, PATH, PATTERN).collect()
