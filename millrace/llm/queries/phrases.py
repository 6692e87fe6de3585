"""Queries on phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.phrases import FREQUENT, collocations, frequent_phrases
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()

MOST, WITHIN, SCALE = 2000, 80, 2_000_000

PHRASES_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), listed AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM listed GROUP BY lang
), counts AS (
    SELECT lang, k AS size, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM listed, range(1, 5) AS s(k), unnest(range(1, len(ws) - k + 2)) AS t(i)
    GROUP BY ALL HAVING count(*) >= {FREQUENT}
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE size >= 2
), inside AS (
    SELECT lang, array_to_string(ws[i:i + n - 1], ' ') AS phrase, max(f) AS longer
    FROM candidates, range(2, 4) AS s(n), unnest(range(1, size - n + 2)) AS t(i)
    WHERE n < size GROUP BY ALL
), kept AS (
    SELECT lang, phrase, f AS a, ws, size FROM candidates LEFT JOIN inside USING (lang, phrase)
    WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(f AS HUGEINT) * {WITHIN}
), cuts AS (
    SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r,
           CAST((CAST(a AS HUGEINT) * {SCALE}) // (h.f + t.f) AS BIGINT) AS score
    FROM kept c, unnest(range(1, size)) AS u(k), counts h, counts t
    WHERE h.lang = c.lang AND h.phrase = array_to_string(ws[1:k], ' ')
      AND t.lang = c.lang AND t.phrase = array_to_string(ws[k + 1:], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n, score
    FROM lowest JOIN totals USING (lang)
)
SELECT * FROM ranked WHERE rank <= {MOST}
"""


@registry.query(PHRASES_SQL)
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return collocations(frequent_phrases(docs), MOST, WITHIN, SCALE)
