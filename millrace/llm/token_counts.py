"""Token counts by overlap resynchronisation.

Texts up to two chunks are counted whole. A longer text is cut into chunks that overlap, each
a row of its own, so that one huge document is spread over tasks. A chunk is encoded with
offsets; its tokens near the cut may be wrong, so neighbouring chunks are spliced at a boundary
that both see: the first place of their common overlap where a sure non-space meets white
space. The vocabulary's pattern never lets a token run over such a place and never looks
further left, so what follows is the same in both. Each chunk counts its tokens from its own
first boundary to the next chunk's. Where an overlap holds no such place, or the tokens of one
of the two run across it, the document's overlaps are widened and its chunks encoded again; in
the end a chunk reaches the end of the text.

Defined results: a null or empty text has no tokens; repeated rows give repeated rows; a null
doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import encoder
from millrace.llm.words import slices

#: Characters of a chunk without its overlap, and of the first overlap.
CHUNK = 32_768
OVERLAP = 256
#: Times an overlap grows when a splice fails.
WIDER = 8

#: A printable ASCII character before a space or line feed: a boundary of tokens for certain.
BOUNDARY = re.compile(r"[!-~](?=[ \n])")


def _whole(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, keep_ids=False)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"),
                 pa.array(own.counts(batch.column("text")), pa.int64())],
                ["row", "doc_id", "n_bytes", "n_tokens"],
            )

    return count


def _chunks(path: str, chunk: int):
    """A count for each chunk, or null where a splice at one of its ends fails."""

    def first_boundary(text: str, start: int, end: int) -> int | None:
        found = BOUNDARY.search(text, start, end)
        return found.end() if found and found.end() < end else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        for batch in batches:
            counts = []
            columns = [batch.column(c).to_pylist() for c in ("text", "place", "last", "overlap")]
            for text, place, last, overlap in zip(*columns, strict=True):
                begin = 0 if place == 0 else first_boundary(text, 0, overlap)
                end = len(text) if last else first_boundary(text, chunk, chunk + overlap)
                if begin is None or end is None:
                    counts.append(None)
                    continue
                offsets = library.encode(text, add_special_tokens=False).offsets
                across = any(a < edge < b for a, b in offsets for edge in (begin, end))
                counts.append(None if across else sum(begin <= a < end for a, _ in offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"),
                 pa.array(counts, pa.int64())],
                ["row", "doc_id", "n_bytes", "n_tokens"],
            )

    return count


SCHEMA = "row long, doc_id long, n_bytes long, n_tokens long"


def count_tokens(
    docs: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs(doc_id, text).

    tokenizer: path of a byte-level vocabulary file, the same on every machine.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    short = F.length("text") <= 2 * chunk
    counted = rows.where(short).mapInArrow(_whole(tokenizer), SCHEMA)
    huge = rows.where(~short)
    width = overlap
    while True:
        parts = (
            huge.withColumn("n_chars", F.length("text"))
            .withColumn("overlap", F.lit(width))
            .select(
                "*",
                F.explode(
                    F.expr(f"sequence(0, cast((greatest(n_chars - {width}, 1) - 1) div {chunk} as int))")
                ).alias("place"),
            )
            .select(
                "row", "doc_id", "n_bytes", "overlap", "place",
                F.expr(f"place = (greatest(n_chars - {width}, 1) - 1) div {chunk}").alias("last"),
                F.expr(f"if(place = (greatest(n_chars - {width}, 1) - 1) div {chunk},"
                       f" substring(text, place * {chunk} + 1),"
                       f" substring(text, place * {chunk} + 1, {chunk + width}))").alias("text"),
            )
            .mapInArrow(_chunks(tokenizer, chunk), SCHEMA)
            .groupBy("row")
            .agg(
                F.first("doc_id").alias("doc_id"),
                F.first("n_bytes").alias("n_bytes"),
                F.sum("n_tokens").alias("n_tokens"),
                F.count_if(F.col("n_tokens").isNull()).alias("failed"),
            )
        )
        parts = parts.checkpoint()
        counted = counted.unionByName(parts.where("failed = 0").drop("failed"))
        again = parts.where("failed > 0").select("row")
        if again.isEmpty():
            break
        huge = huge.join(again, "row", "left_semi")
        width *= WIDER
    return counted.drop("row")
