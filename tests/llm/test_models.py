"""Toxicity and language-model scores: held-out accuracy and exact base scores."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import docs, passage, texts
from pyspark.sql import functions as F

from millrace.llm.language_model import WEIGHT, asked, built, count_of, levels_of, score_texts
from millrace.llm.queries.classifiers import TOXIC, remainder
from millrace.llm.toxicity import fit_toxicity, sampled_labels
from millrace.llm.words import mix


def test_toxicity_of_unseen_texts(spark):
    rows = [(k, passage(k, 60) + (" slurword trash " if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    labels = table.where("doc_id < 300").select("doc_id", "toxic")
    model = fit_toxicity(table, labels)
    scored = model.score(docs(spark)).collect()
    assert len(scored) == len(texts()) and all(0 <= r.score <= 1 for r in scored)
    unseen = table.where("doc_id >= 300").drop("toxic").withColumn("features", F.lit("mine"))
    for row in model.score(unseen).collect():
        assert (row.score >= TOXIC) == (row.doc_id % 4 == 0)
        assert row.features == "mine"


def test_without_labels_insults_alone_decide(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, "you absolute idiot"), (2, "a fine day"), (3, None), (4, "1d10t idi0t")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in fit_toxicity(table, none).score(table).collect()}
    assert found[1] >= TOXIC and found[4] >= TOXIC and found[2] < TOXIC and found[3] < TOXIC


def test_few_labels_still_grow_trees_and_calibrate(spark):
    """Six toxic rows, of which each fold has some."""
    rows = [(k, passage(k, 60) + (" trash slurword idiot" if k % 10 == 0 else ""), int(k % 10 == 0)) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(table, table.select("doc_id", "toxic"))
    assert model.trees is not None and model.calibration is not None
    assert model.score(table.limit(0)).isEmpty()
    none = fit_toxicity(table.limit(0), table.select("doc_id", "toxic"))
    assert none.trees is None and none.score(table.limit(0)).isEmpty()


def test_a_class_that_is_cut_weighs_more(spark):
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(1000)], "doc_id long, toxic int")
    found = sampled_labels(labels, 150).groupBy("toxic", "weight").count().collect()
    assert {tuple(r) for r in found} == {(1.0, 1.0, 100), (0.0, 6.0, 150)}


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


def brute_scores(rows):
    """(doc_id, n_tokens, n_known, train_tokens, base_score) and the score without false hits."""

    def quantised(c):
        return float(count_of(levels_of(np.array([c])))[0])

    counts, pairs = Counter(), Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            own = tokens(t)
            counts.update(own)
            pairs.update(zip(["<start>", *own], own, strict=False))
    n, v = sum(counts.values()), len(counts)
    starts = sum(c for (before, _), c in pairs.items() if before == "<start>")
    total = n + 0.1 * (v + 1)
    exact, scores = [], []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / total) for w in own)
        exact.append((i, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
        score = 0.0
        for before, w in zip(["<start>", *own], own, strict=False):
            history = quantised(starts if before == "<start>" else counts[before])
            both = min(quantised(pairs[before, w]), history)
            score += math.log10((both + WEIGHT * (quantised(counts[w]) + 0.1) / total) / (history + WEIGHT))
        scores.append((i, len(own), score))
    return exact, scores


@pytest.mark.parametrize("block,text_block", [(1 << 20, 4 << 20), (700, 3000)])
def test_scores_match_brute_force(spark, block, text_block):
    """Base scores exactly; the others up to false hits of the filter, which are rare and small."""
    exact, scores = brute_scores(texts())
    found = score_texts(docs(spark).checkpoint(), remainder(10) != 0, block, text_block).collect()
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert Counter(got) == Counter(exact)
    by_doc = {(i, n): score for i, n, score in scores}
    off = np.array([abs(r.score - by_doc[r.doc_id, r.n_tokens]) / r.n_tokens for r in found])
    # A pair in a hundred is taken for seen once, which adds a few tenths to its logarithm.
    assert np.median(off) < 5e-3 and off.max() < 0.2


def test_false_hits_are_as_rare_as_said():
    keys = mix(np.arange(220_000, dtype=np.uint64), 77)
    counts = np.random.default_rng(1).geometric(0.5, 20_000)
    bits = built(keys[:20_000], counts)
    assert (asked(bits, keys[:20_000]) >= levels_of(counts)).all()
    false = (asked(bits, keys[20_000:]) > 0).mean()
    assert 0.005 < false < 0.015


def test_repeated_text_is_likelier_than_by_its_words_alone(spark):
    rows = [(k, passage(k % 5, 80)) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    held = score_texts(table, remainder(10) != 0).where(remainder(10) == 0).collect()
    assert held and all(r.score > r.base_score for r in held)


def test_nothing_to_learn_from(spark):
    found = score_texts(docs(spark), F.lit(False)).collect()
    assert len(found) == len(texts()) and all(r.base_score == 0 and r.score == 0 for r in found)
    assert score_texts(docs(spark).limit(0), F.lit(True)).count() == 0
