"""Queries that remove repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.byte_spans import remove_repeated_bytes
from millrace.llm.near_duplicates import near_duplicates
from millrace.llm.substrings import remove_repeated_windows
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()

SUBSTRING_SQL = """
WITH listed AS (
    SELECT doc_id,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                       lambda x: x <> '') AS ws
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
    FROM listed, unnest(range(1, len(ws) - 11)) AS t(i)
), firsts AS (
    SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s
), gone AS (
    SELECT DISTINCT doc_id, i + k AS p
    FROM windows JOIN firsts USING (s), range(0, 13) AS r(k)
    WHERE first_doc < doc_id
), words AS (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM listed
), cut AS (
    SELECT doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed,
           string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS kept
    FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM listed LEFT JOIN cut USING (doc_id)
"""


@registry.query(SUBSTRING_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.btrim(
        F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), F.lit(" ")
    )
    return remove_repeated_windows(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256")
    )


@registry.query(None)
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@registry.query(None)
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256")
    )
