"""Queries on the quality of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import host_rules as rules
from millrace.llm.decontamination import overlaps
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()

_RULES_SQL = {
    "base": "base_failed",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines AND n_lines > 0",
}


def _prior(name: str) -> str:
    """Mean and strength of the beta prior by the moments of the beta-binomial distribution."""
    mean = f"(sum({name}) OVER () / sum(n) OVER ())"
    room = "(sum(n) OVER () - count(*) OVER () - sum(CAST(n AS DOUBLE) * n) OVER () / sum(n) OVER () + 1)"
    share = (
        f"((sum(CAST({name} AS DOUBLE) * {name} / n) OVER () - {mean} * {mean} * sum(n) OVER ())"
        f" / ({mean} * (1 - {mean})) - (count(*) OVER () - 1)) / {room}"
    )
    return (
        f"{mean} AS {name}_mean, CASE WHEN {mean} <= 0 OR {mean} >= 1 OR {room} <= 0 THEN {rules.STRONGEST}"
        f" WHEN {share} > 0 THEN least(greatest(1 / ({share}) - 1, {rules.WEAKEST}), {rules.STRONGEST})"
        f" ELSE {rules.STRONGEST} END AS {name}_strength"
    )


QUALITY_SQL = f"""
WITH listed AS (
    SELECT doc_id, coalesce(source, '') AS host,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                       lambda x: x <> '') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
           length(coalesce(text, ''))
             - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols
    FROM documents
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS times
    FROM listed, unnest(range(1, len(ws) - 1)) AS t(i)
), repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM windows, range(0, 3) AS r(k) WHERE times > 1 GROUP BY doc_id
), measured AS (
    SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT)
             AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM listed LEFT JOIN repeated USING (doc_id)
), judged AS (
    SELECT *, n_words < {rules.LEAST_WORDS}
              OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed
    FROM measured
), hosts AS (
    SELECT host, count(*) AS n,
           {", ".join(f"count(*) FILTER ({rule}) AS {name}" for name, rule in _RULES_SQL.items())}
    FROM judged GROUP BY host
), priors AS (
    SELECT *, {", ".join(_prior(name) for name in _RULES_SQL)} FROM hosts
), verdicts AS (
    SELECT host, {" OR ".join(
        f"({name} + {name}_mean * {name}_strength) / (n + {name}_strength) > {rules.RULES[name][1]}"
        for name in _RULES_SQL
    )} AS refused
    FROM priors
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT refused AS kept
FROM judged JOIN verdicts USING (host)
"""


@registry.query(QUALITY_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return rules.with_verdicts(docs, "doc_id")


@registry.query(None)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each text that holds a benchmark passage, and each item; clean texts give none."""
    return overlaps(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark"),
    )
