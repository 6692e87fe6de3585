"""Removal of repeats and near duplicates against brute force on a small odd table."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd import docs, passage, texts
from pyspark.sql import functions as F

from millrace.llm.byte_spans import _segments, crowded_anchors, first_documents, remove_repeated_bytes
from millrace.llm.near_duplicates import components, linked_labels, near_duplicates, shingles
from millrace.llm.repeats import SLICE, packed
from millrace.llm.substrings import remove_repeated_windows

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def covered(items, size: int, rows):
    """For every row which items lie in a run of `size` that a row of smaller id also has."""
    first: dict = {}
    for doc_id, text in rows:
        seq = items(text)
        for k in range(len(seq) - size + 1):
            if doc_id is not None:
                key = tuple(seq[k : k + size])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        seq = items(text)
        gone = [False] * len(seq)
        for k in range(len(seq) - size + 1):
            if doc_id is not None and first[tuple(seq[k : k + size])] < doc_id:
                gone[k : k + size] = [True] * size
        out.append((doc_id, seq, gone))
    return out


def test_word_windows_match_brute_force(spark):
    found = remove_repeated_windows(docs(spark))
    assert {"block", "digest", "given", "score", "kept"} <= set(found.columns)
    expected = Counter(
        (i, len(seq), sum(gone), tuple(w for w, g in zip(seq, gone) if not g))
        for i, seq, gone in covered(words, 13, texts())
    )
    rows = found.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, tuple(words(r.text))) for r in rows) == expected
    untouched = {(r.doc_id, r.text) for r in rows if not r.n_removed}
    assert untouched <= set(texts())


def test_byte_windows_match_brute_force(spark):
    rows = [r for r in texts() if not r[1] or len(r[1]) < 20_000]
    table = docs(spark).where("text IS NULL OR length(text) < 20000")
    found = remove_repeated_bytes(table).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("h")
    )
    expected = Counter()
    for i, seq, gone in covered(lambda t: (t or "").encode(), 50, rows):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(seq, gone) if not g)
        expected[i, len(seq), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, found.collect())) == expected


def test_crowded_anchors_go_by_single_windows(spark):
    """A phrase shorter than a window, in other surroundings each time, fills no bucket."""
    phrase = " " + "-=" * 20 + " "
    rows = [(k, passage(k, 12) + phrase + passage(1000 + k, 12)) for k in range(300)]
    rows += [(500 + k, passage(k, 12)[-15:] + phrase + passage(1000 + k, 12)[:9]) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    crowds = crowded_anchors(table, 50, 100, 1)
    assert len(crowds)
    for choice in ({"crowded": 100, "sampled": 1}, {}):
        found = {r.doc_id: (r.n_removed, bytes(r.kept_bytes)) for r in remove_repeated_bytes(table, **choice).collect()}
        for i, seq, gone in covered(lambda t: t.encode(), 50, rows):
            assert found[i] == (sum(gone), bytes(b for b, g in zip(seq, gone) if not g))
    assert sum(found[500 + k][0] > 0 for k in range(40)) == 40
    every = packed(np.arange(SLICE))
    flags = pa.table({
        "block": [0, 0], "slice": [0, 1], "cells": [every, every],
        "copy_id": pa.nulls(2, pa.int64()), "copied": pa.nulls(2, pa.string()),
    })
    ids, given = zip(*rows)
    block = pa.table({"block": [0] * len(rows), "doc_id": ids, "text": given, "digest": given})
    sent = _segments(50, SLICE, 1000, crowds)(block, flags)
    assert Counter(sent.column("bucket").to_pylist()).most_common(1)[0][1] < 100


@pytest.mark.parametrize("size", [3, 8])
def test_merged_transforms_find_first_documents(size):
    strings = [b"abracadabra", b"abracadabrab", b"cadabra", b"aaaaaaaaaa", b"xyz", b"aab"]
    import numpy as np

    low = np.array([5, 3, 9, 1, 4, 7])
    first: dict = {}
    for s, d in zip(strings, low):
        for k in range(len(s) - size + 1):
            first[s[k : k + size]] = min(first.get(s[k : k + size], 99), d)
    for s, least in zip(strings, first_documents(strings, low, size), strict=True):
        assert least.tolist() == [first[s[k : k + size]] for k in range(len(s) - size + 1)]


def classes(rows):
    def lower(text):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")

    sets = {}
    for i, t in rows:
        if i is not None:
            w = words(lower(t))
            whole = [tuple(w)] if w else []
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset(whole)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("leaf", [3072, 8])
def test_near_duplicates_match_brute_force(spark, leaf):
    """With small leaves every group goes by chunks, pivots and branches."""
    found = near_duplicates(docs(spark), leaf).collect()
    expected = classes(texts())
    assert len(found) == len(texts())
    for row in found:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id, row.kept) == expected[row.doc_id]


def test_a_passage_in_many_texts_makes_no_class(spark):
    rows = [(k, passage(k, 60) + " " + passage(0, 30)) for k in range(1, 200)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("NOT kept").isEmpty()


def test_components_follow_long_chains(spark):
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(links)
    assert found.count() == 59 and found.where("component <> 1").isEmpty()


def near_copies(n: int) -> list[tuple[int, str]]:
    """Texts of 100 words with two words changed in each: about the threshold from each other."""
    base, rows = passage(10, 100).split(), []
    for k in range(n):
        copy = list(base)
        for place in random.Random(k).sample(range(100), 2):
            copy[place] = f"n{k}"
        rows.append((k, " ".join(copy)))
    return rows


def test_work_in_a_group_of_near_copies_grows_with_the_logarithm_for_each_text():
    """A text is held against all others only while the largest class lacks it: about log n over
    the share of linked pairs times in all, where comparing all pairs takes n times."""
    held = []
    for n in (150, 600, 2400):
        value, bounds = shingles(pa.array([text for _, text in near_copies(n)]))
        sets = [value[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        edges, times = linked_labels(np.arange(n), np.zeros((n, 32), dtype=np.uint8), sets)
        assert len(edges) < n
        held.append(times)
    assert held[1] <= 2 * held[0] and held[2] <= 3 * held[0]


@pytest.mark.parametrize("operator", [remove_repeated_windows, remove_repeated_bytes, near_duplicates])
def test_empty_tables(spark, operator):
    assert operator(docs(spark).limit(0)).count() == 0
