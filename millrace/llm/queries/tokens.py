"""Queries on token ids: packing and token counts. SQL has no tokenizers, so neither has SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import decode, encode
from millrace.llm.packing import pack
from millrace.llm.token_counts import count_tokens
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
TOKEN_LIMIT = 1024


@registry.query(None)
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)
    return pieces.drop("ids")


@registry.query(None)
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@registry.query(None)
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    ranks = public_tokenizers.path(RANKS)
    encoded = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
