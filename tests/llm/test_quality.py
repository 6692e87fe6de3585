"""Quality rules and decontamination on small tables, and their plans."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from odd import docs, passage, passage_of

from millrace.llm.decontamination import AROUND, LEAST_EQUAL, LEAST_SHARE, MASKS, SPAN, overlaps, whole_masks
from millrace.llm.host_rules import beta_prior, with_verdicts


def test_hosts_that_fail_throughout_are_refused(spark):
    def prose(k):
        return passage(k, 80)

    rows = [(k, prose(k), "good") for k in range(40)]
    rows += [(100 + k, prose(100 + k) + " " + "### " * 60, "bad") for k in range(30)]
    rows += [(200, prose(200), "bad"), (201, None, "good"), (202, "", None), (203, prose(5), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in with_verdicts(table, "doc_id").collect()}
    assert all(found[k].kept for k in range(40))
    assert not found[200].base_failed and not found[200].kept
    assert found[201].base_failed and found[201].n_words == 0 and found[203].kept


def test_hosts_of_one_document_are_not_refused_for_it(spark):
    """A host of one document says nothing about hosts, however many of them fail."""
    rows = [(k, passage(k, 80) + (" " + "### " * 60 if k % 10 < 3 else ""), f"host{k}") for k in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert with_verdicts(table, "doc_id").where("NOT kept").isEmpty()


def test_prior_is_as_strong_as_the_hosts_are_alike():
    """Sums as with_verdicts makes them, for hosts of (documents, failures)."""

    def prior(hosts):
        return beta_prior(
            len(hosts), sum(n for n, _ in hosts), sum(n * n for n, _ in hosts), sum(x for _, x in hosts),
            sum(x * x / n for n, x in hosts),
        )

    draw = np.random.default_rng(4)
    alike = prior([(50, int(x)) for x in draw.binomial(50, 0.2, 400)])
    assert abs(alike[0] - 0.2) < 0.02 and alike[1] > 200
    rates = draw.beta(2, 8, 4000)
    sizes = draw.integers(1, 40, 4000)
    mean, strength = prior([(int(n), int(x)) for n, x in zip(sizes, draw.binomial(sizes, rates), strict=True)])
    assert abs(mean - 0.2) < 0.02 and 8 < strength < 12.5
    assert prior([(40, 0), (30, 30)])[1] < 0.5
    assert prior([]) == prior([(5, 0)]) == (0.0, 1_000_000.0)


def test_words_in_repeated_windows(spark):
    rows = [(1, "a b c x a b c y", "s"), (2, "a a a a", "s"), (3, "a b", "s"), (4, "l\nl\n \nl\nm", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in with_verdicts(table, "doc_id").collect()}
    assert found == {1: (6, 0), 2: (4, 0), 3: (0, 0), 4: (0, 2)}


def test_passages_are_found_with_substitutions_and_nothing_else_is(spark):
    item = passage_of("q", 40)
    changed = item.split()
    for place in (7, 19, 33):
        changed[place] = "other"
    rows = [
        (1, passage(1, 900) + " " + item), (2, passage(2, 50) + " " + " ".join(changed) + " " + passage(3, 30)),
        (3, item.upper().replace(" ", ", ")), (4, passage(4, 700)), (5, " ".join(item.split()[:8])),
        (6, None), (7, ""), (None, item), (9, passage(9, 30) + " " + passage_of("s", 8)),
        (10, " ".join(item.split()[:20]) + " " + passage(10, 600)),
    ]
    bench = [(1, item), (2, None), (3, "too short"), (4, passage_of("s", 8)), (1, item), (5, "")]
    texts = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int")
    items = spark.createDataFrame(bench, "item_id long, text string")
    for block_rows in (50_000, 20):
        found = {(r.doc_id, r.item_id) for r in overlaps(texts, items, block_rows).collect()}
        assert found == {(1, 1), (2, 1), (3, 1), (None, 1), (9, 4), (10, 1)}


def brute_overlaps(rows, bench):
    """{(doc_id, item_id): n_equal} by laying every place of every text on every place of every item."""

    def tokens(text):
        return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]

    def masks(n):
        whole = [m for m in whole_masks(n)] if n <= SPAN else []
        return [(m, False) for m in MASKS] + [(m, True) for m in whole]

    best: dict = {}
    items = {(i, tuple(tokens(t))) for i, t in bench}
    for doc_id, text in rows:
        words = tokens(text)
        for item_id, item in items:
            n = len(item)
            if n < 2:
                continue
            for p in range(len(words)):
                for q in range(n):
                    hit = any(
                        (q == 0 if whole else q + SPAN <= n) and p + len(m) <= len(words)
                        and all(words[p + k] == item[q + k] for k, bit in enumerate(m) if bit == "1")
                        for m, whole in masks(n)
                    )
                    if hit:
                        low = max(q - AROUND, 0)
                        equal = sum(
                            0 <= p + k - q < len(words) and words[p + k - q] == item[k]
                            for k in range(low, min(low + 2 * AROUND, n))
                        )
                        best[doc_id, item_id] = max(best.get((doc_id, item_id), 0), equal)
    sizes = dict((i, len(t)) for i, t in items)
    return {
        key: n for key, n in best.items()
        if n >= min(LEAST_EQUAL, math.ceil(LEAST_SHARE * sizes[key[1]]))
    }


def test_overlaps_match_brute_force(spark):
    """Texts of few different words, so that seeds hit by chance as well, and planted passages."""
    draw = random.Random(8)
    few = [f"v{k}" for k in range(4)]
    bench = [(k, " ".join(draw.choices(few, k=draw.choice([3, 7, 12, 14, 20, 70])))) for k in range(12)]
    bench += [(50 + k, passage(900 + k, 25)) for k in range(4)]
    rows = [(k, " ".join(draw.choices(few, k=draw.choice([5, 40, 60])))) for k in range(12)]
    for k in range(8):
        words = passage(900 + k % 4, 25).split()[draw.randrange(4) :]
        for place in draw.sample(range(len(words)), k):
            words[place] = "other"
        rows.append((100 + k, f"{passage(k, 30 + 97 * k)}, {' '.join(words)}. {passage(50 + k, 20)}"))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    expected = brute_overlaps(rows, bench)
    assert len(expected) > 10
    for block_rows in (50_000, 30):
        found = {(r.doc_id, r.item_id): r.n_equal for r in overlaps(texts, items, block_rows).collect()}
        assert found == expected


def test_short_items_and_scripts_without_spaces(spark):
    lengths = {n: passage_of(f"t{n}x", n) for n in (2, 3, 5, 6, 9, 11, 12)}
    bench = [*lengths.items(), (100, "Photosynthesis"), (101, "yes"), (102, "水は何度で沸騰しますか"), (103, "首都")]
    rows, expected = [], set()

    def add(text, item=None):
        rows.append((len(rows), f"{passage(len(rows), 20)} {text} {passage(500 + len(rows), 20)}"))
        if item is not None:
            expected.add((len(rows) - 1, item))

    for n, item in lengths.items():
        add(item, n)
        for place in range(n):
            words = item.split()
            words[place] = "other"
            add(" ".join(words), n if n >= 6 else None)
    add("of photosynthesis yes", 100)
    add("質問。水は百度で沸騰しますか。", 102)
    add("その首都の", 103)
    add("首の都")
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in overlaps(texts, items).collect()} == expected


def test_no_python_runs_on_the_main_path(spark):
    table = docs(spark).withColumnRenamed("digest", "source")
    bench = spark.createDataFrame([(1, passage(1, 40))], "item_id long, text string")
    for df in (with_verdicts(table, "doc_id"), overlaps(table, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty_tables(spark):
    table = docs(spark).withColumnRenamed("digest", "source").limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert with_verdicts(table, "doc_id").count() == 0
    assert overlaps(table, bench).count() == 0
    assert overlaps(docs(spark), bench).count() == 0
