"""The trie against dictionaries of prefixes."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm.prefix_trie import NOTHING, grafted, paths_of, prefix_trie
from millrace.llm.queries.conversations import op12_prefix_trie
from pyspark.sql import functions as F


def expected(rows) -> Counter:
    """rows: (conv_id, turn, role, text) without equal turns of different content."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((-math.inf if turn is None else turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(dict)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])][c] = len(path)
    nodes = {}
    for path in sorted(members, key=len, reverse=True):
        kids = [nodes[k] for k in members if len(k) == len(path) + 1 and k[: len(path)] == path]
        chars = len(path[-1][1]) if path else 0
        ends = ",".join(str(c) for c in sorted(members[path]) if members[path][c] == len(path))
        nodes[path] = {
            "kids": len(kids), "leaves": sum(k["leaves"] for k in kids) or 1,
            "saved": (len(members[path]) - 1) * chars + sum(k["saved"] for k in kids),
            "sha": hashlib.sha256(ends.encode()).hexdigest(),
        }
    return Counter(
        (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), n["kids"], n["leaves"],
         n["saved"], n["sha"])
        for p, n in nodes.items()
    )


def conversations() -> list[tuple]:
    """A first turn that a third share, copies of one conversation, very long ones, odd rows."""
    rows = []
    for c in range(900, 1300):
        n = zlib.crc32(b"n%d" % c) % 7
        start = [("user", "hello")] if c % 3 == 0 else []
        rows += [(c, t, *x) for t, x in enumerate([*start, *(("user", f"{c % 37} {t}") for t in range(n))])]
    rows += [(2000 + c, t, "user", f"same {t}") for c in range(150) for t in range(9)]
    rows += [(3000 + c, t, "user", f"long {t if t < 60 + c else c}") for c in range(4) for t in range(90)]
    rows += [(5, 1, None, "b"), (5, None, "a", None), (5, 1, None, "b"), (None, 1, "a", "b"), (-7, 0, "x", "y"), (-7, 3, "", "z")]
    return rows + [(4001, 0, "user", "only"), (4004, 0, "ab", "c"), (4007, 0, "a", "bc")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shards,fan", [(None, 256), (1, 2), (40, 3), (25, 2)])
def test_nodes_match_dictionaries(spark, shards, fan):
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit(1)).repartition(5)
    found = prefix_trie(grafted(paths_of(table), 6, 100), shards, fan)
    assert Counter(map(tuple, found.collect())) == expected(rows)


def test_query_on_clashing_columns_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = conversations() * 2
    names = ("key", "shard", "chars", "ids", "open", "depth")
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in names})
    table.write.parquet(f"{tmp_path}/a/conversations.parquet")
    table.limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert Counter(map(tuple, op12_prefix_trie(spark, f"{tmp_path}/a").collect())) == expected(rows)
    assert op12_prefix_trie(spark, f"{tmp_path}/b").count() == 0


def test_only_turnless_conversations(spark):
    """201 and 203 lose all their turns to an absent base."""
    c = [k for k in range(201, 300) if zlib.crc32(str(k).encode()) % 6 > 0][:3]
    table = spark.createDataFrame([(k, 0, "a", "b") for k in c], SCHEMA)
    row, = prefix_trie(grafted(paths_of(table), 6, 100), 3).collect()
    ends = hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    assert tuple(row) == (c[0], 0, None, 3, 0, 1, 0, ends) and ends != NOTHING
