"""Phrase counts and collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import phrases
from millrace.llm.phrases import collocations, frequent_phrases
from millrace.llm.queries.phrases import op11_phrase_mining

UPPER = {c: c + 32 for c in range(65, 91)}


def occurrences(rows) -> tuple[Counter, Counter]:
    """rows: (text, lang). Counts of (lang, phrase) and of words by lang."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update(
                (lang, " ".join(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1)
            )
    return counts, +totals


def expected(rows, frequent: int, most: int) -> list[tuple]:
    counts, totals = occurrences(rows)
    counts = {k: f for k, f in counts.items() if f >= frequent}
    longer = Counter()
    for (lang, phrase), f in counts.items():
        words = phrase.split(" ")
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                key = lang, " ".join(words[i : i + n])
                longer[key] = max(longer[key], f)
    out = []
    for lang in totals:
        own = []
        for (of, phrase), a in counts.items():
            words = phrase.split(" ")
            if of != lang or len(words) < 2 or 100 * longer[of, phrase] >= 80 * a:
                continue
            cuts = []
            for k in range(1, len(words)):
                l, r = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
                cuts.append((2_000_000 * a // (l + r), k, l, r))
            score, _, l, r = min(cuts)
            own.append((-score, -a, phrase.encode(), phrase, a, l, r, score))
        for rank, (*_, phrase, a, l, r, score) in enumerate(sorted(own)[:most], 1):
            out.append((lang, rank, phrase, a, l, r, totals[lang], score))
    return sorted(out)


def rows() -> list[tuple]:
    """Frequent and rare words, set phrases, odd separators, nulls, one long text, repeated rows."""
    draw = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    found = []
    for k in range(700):
        text = draw.choices(words, weights=[1 / (i + 1) for i in range(300)], k=40)
        if k % 5 == 0:
            text[10:10] = ["As", "A", "matter", "of", "fact"]
        if k % 9 == 0:
            text[20:20] = [f"new{k % 2}", "york", "city"]
        sep = draw.choice([" ", "  ", "\t", " \t "])
        found.append((sep.join(text) + draw.choice([".", "\n", " ?", "\x0b", ""]), draw.choice(["en", "de", None, "", "und"])))
    found += [("a b, a b; a b\x0c" * 200, "en"), ("x " * 50_000, "fr"), (None, "en"), ("", None), (" . ", "es")]
    found += [("É é\u00a0É Ärger über alles " * 40, "de")] * 3
    return found


@pytest.mark.parametrize(
    "share,proposed,block,buckets", [(8, 2, 4 << 20, None), (1, 1, 5000, 3), (10**9, 2, 3000, 7), (3, 30, 1 << 16, 2)]
)
def test_counts_are_exact_whatever_the_sample_proposes(spark, share, proposed, block, buckets):
    """With a share of 1 in 10**9 nothing is proposed; with a high threshold little is."""
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows())], "doc_id long, text string, lang string")
    found = frequent_phrases(table.repartition(6).checkpoint(), 30, share, proposed, block, buckets).collect()
    counts, totals = occurrences(rows())
    assert {(r.lang, r.phrase): r.f for r in found if r.size} == {k: f for k, f in counts.items() if f >= 30}
    assert {r.lang: r.f for r in found if not r.size} == totals
    assert len(found) == len({(r.lang, r.phrase) for r in found})


def test_query_on_clashing_columns_and_empty_tables(spark, tmp_path):
    given = [(k // 2, *r) for k, r in enumerate(rows())]
    table = spark.createDataFrame(given, "doc_id long, text string, lang string")
    table = table.withColumns({n: F.lit(1) for n in ("phrase", "f", "size", "key", "bucket", "n", "sampled")})
    table.repartition(4).write.parquet(f"{tmp_path}/a/documents.parquet")
    table.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert sorted(map(tuple, op11_phrase_mining(spark, f"{tmp_path}/a").collect())) == expected(rows(), 30, 2000)
    assert op11_phrase_mining(spark, f"{tmp_path}/b").count() == 0


def test_ranks_stop_and_products_pass_64_bits(spark):
    big = 9_000_000_000_000_000_000
    counts = [("x", 0, "", big), ("x", 1, "a", big), ("x", 1, "b", big - 1), ("x", 2, "a b", big - 1), ("x", 2, "b a", 40)]
    table = spark.createDataFrame(counts, "lang string, size long, phrase string, f long")
    got = sorted(map(tuple, collocations(table, 1, 80, 2_000_000).collect()))
    score = 2_000_000 * (big - 1) // (2 * big - 1)
    assert got == [("x", 1, "a b", big - 1, big, big - 1, big, score)]


def test_a_block_sends_as_many_rows_however_many_partitions(spark, monkeypatch):
    """Else rows grow with blocks times partitions, the square of the input."""
    real, sent = phrases.counted, []

    def seen(texts, pick, sizes, threshold, buckets, block, label):
        sent.append(texts.mapInArrow(phrases._counts(pick, sizes, buckets, block), phrases.COUNTS).count())
        return real(texts, pick, sizes, threshold, buckets, block, label)

    monkeypatch.setattr(phrases, "counted", seen)
    texts = [(k, " ".join(f"w{k * j}" for j in range(200)), "en") for k in range(8)]
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string").checkpoint()
    found = []
    for partitions in (8, 64):
        frequent_phrases(table.repartition(partitions, "doc_id"), block=1)
        found.append([*sent])
        sent.clear()
    assert found[0] == found[1]


@pytest.mark.parametrize("waiting", [1, 1 << 20])
def test_a_bucket_is_added_up_batch_by_batch(waiting):
    def batch(phrases_, counts, languages, totals):
        ends = b"".join(b"en\xff" + p + b"\xfe" for p in phrases_)
        return pa.record_batch(
            [pa.array([0]), pa.array([ends]), pa.array([np.array(counts, "<u4").tobytes()]),
             pa.array([languages], pa.list_(pa.string())), pa.array([totals], pa.list_(pa.int64()))],
            ["bucket", "phrases", "counts", "languages", "totals"],
        )

    batches = [batch([b"a b", b"c"], [2, 1], ["en"], [7]), batch([], [], [], []), batch([b"c", b"a b"], [1, 4], ["en"], [5])]
    (found,) = phrases._sums(3, waiting)(iter(batches))
    assert [(r["lang"], r["size"], r["phrase"], r["f"]) for r in found.to_pylist()] == [
        ("en", 0, "", 12), ("en", 2, "a b", 6)
    ]
