"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.prefix_trie import grafted, paths_of, prefix_trie
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()

#: Conversations of a hundred share fewer than GRAFTED first turns of the first of them.
GRAFTED, OF = 6, 100

TRIE_SQL = f"""
WITH crc_table AS (
    SELECT list_transform(range(256), lambda byte: list_reduce(
        range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END,
        CAST(byte AS BIGINT))) AS steps
), turns AS (
    SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS xs FROM turns GROUP BY conv_id
), drawn AS (
    SELECT conv_id, xs, xor(list_reduce(
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda crc, b: xor(crc // 256, steps[1 + xor(crc, b) % 256]), 4294967295), 4294967295) % {GRAFTED} AS h
    FROM own, crc_table
), rebuilt AS (
    SELECT d.conv_id, list_concat(coalesce(b.xs[1:h], []), d.xs[h + 1:]) AS xs
    FROM drawn d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % {OF}
), members AS (
    SELECT conv_id, len(xs) AS n, CAST(d AS BIGINT) AS depth, xs[1:d] AS path
    FROM rebuilt, unnest(range(0, len(xs) + 1)) AS u(d)
), nodes AS (
    SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
           CASE WHEN depth > 0 THEN (count(*) - 1) * length(path[depth].t) ELSE 0 END AS saved,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
    FROM members GROUP BY depth, path
), kids AS (
    SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children
    FROM nodes WHERE depth > 0 GROUP BY 1, 2
), subtrees AS (
    SELECT CAST(a AS BIGINT) AS depth, n.path[1:a] AS path, sum(saved) AS saved_tokens,
           count(*) FILTER (k.n_children IS NULL) AS n_leaves
    FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path, unnest(range(0, n.depth + 1)) AS u(a)
    GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
       CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN subtrees s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""


@registry.query(TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = paths_of(table(spark, sf_dir, "conversations"))
    return prefix_trie(grafted(paths, GRAFTED, OF))
