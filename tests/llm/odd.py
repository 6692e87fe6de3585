"""Small tables with the odd cases that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = [f"w{k}" for k in range(400)]


def passage(seed: int, n: int) -> str:
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def passage_of(stem: str, n: int) -> str:
    return " ".join(f"{stem}{k}" for k in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empties, copies, near copies, shared passages, one long text."""
    shared, hot = passage(1, 40), passage(2, 25)
    rows: list[tuple[int | None, str | None]] = [
        (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "two words"), (8, "one"),
        (None, passage(30, 60)), (None, None),
        (10, passage(3, 120)), (9, passage(3, 120)), (11, passage(3, 120) + " more"),
        (12, "Ärger für über " + passage(4, 30) + " é"), (13, "x" * 300), (14, "x" * 120 + " end"),
        (20, passage(5, 50) + " " + shared + " " + passage(6, 50)),
        (21, shared + "\n\n" + passage(7, 50)),
        (22, passage(8, 20) + "\n" + shared),
        (30, passage(9, 6000)),
        (31, passage(9, 6000)[:9000]),
    ]
    base = passage(10, 100).split()
    for k in range(60):
        copy = list(base)
        for place in random.Random(k).sample(range(100), 2):
            copy[place] = f"n{k}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(200 + k, passage(50 + k, 40) + " " + hot) for k in range(40)]
    rows += [(300 + k, passage(999, 60)) for k in range(30)]
    random.Random(0).shuffle(rows)
    return [*rows, rows[0]]


def docs(spark: SparkSession) -> DataFrame:
    """With extra columns whose names clash with the operators' own."""
    rows = [(i, t, 1, "d", "n", 2, True) for i, t in texts()]
    return spark.createDataFrame(
        rows, "doc_id long, text string, block int, digest string, given string, score int, kept boolean"
    ).repartition(5)
