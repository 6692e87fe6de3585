"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon (strong entries, summed weights, the largest
weight), hits near a second-person word, and rates of capitals, shouted words, punctuation
marks and obfuscated letters. Tokens are runs of letters, lower case; a digit or sign that
stands for a letter inside a word is read as that letter, and counted as obfuscation.

The lexicon is learned: whole words, and beginnings of words of 4 to 12 bytes, that are much
more frequent in toxic than in other training texts, beside a few fixed insults. At every size
it, the trees and the calibration are cross-fitted over FOLDS parts of the labelled rows: a row's
features come from the lexicon of the other parts, and the calibration is fitted to the scores
that trees of the other parts give each row; the final lexicon and trees see all rows. Of either
class at most SAMPLE rows are used, those with the smallest hashes, so that rare toxic labels
are all taken; rows of a class that is cut weigh more in the calibration, by as much as was cut.
Scoring covers every row.

Defined results: a null or empty text has all features zero and gets the score that the trees
and the calibration give it; a null doc_id keeps its row; if no row, or none of one class, is
labelled there is nothing to learn, and the score follows from the number of fixed insults;
repeated rows are repeated in the result; all given columns are kept but one called score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.scratch import stored
from millrace.llm.words import BASES, MASK, slices, span_hashes, text_bytes

#: Labelled rows of either class that are used for fitting, at most.
SAMPLE = 10_000
FOLDS = 2
#: Entries of the learned lexicon, at most: the best by SURE's measure, of which the test tables
#: give a few hundred. It travels with every task.
ENTRIES = 2_000
TREES, DEPTH = 30, 4
#: An entry's log odds times the root of its toxic texts, at least: few texts prove nothing.
SURE = 6
#: Words from a lexicon hit within which a second-person word counts as near.
NEAR = 4

#: Common insults.
INSULTS = """
    idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting filth vermin
    imbecile bastard dummkopf arschloch abschaum connard salaud ordure cretin idiota estupido
    basura escoria imbecil
""".split()  # noqa: SIM905
#: Second-person words.
SECOND_PERSON = """
    you your yours yourself ye du dich dir dein deine ihr euch tu te toi vous votre ton tes
    tus ti usted ustedes vosotros
""".split()  # noqa: SIM905
#: Signs that stand for letters inside words.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

BEGINNINGS = (4, 5, 6, 7, 8, 10, 12)
FEATURES = (
    "strong_rate", "weight_rate", "largest", "strong_hits", "near_you_rate", "you_rate",
    "capital_rate", "shouted_rate", "mark_rate", "bang_rate", "obfuscated_rate", "log_length",
    "weak_rate", "repeat_rate",
)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SIGN = np.zeros(256, dtype=np.uint8)
for _sign, _letter in STANDS_FOR.items():
    _SIGN[ord(_sign)] = ord(_letter)
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def word_hash(word: str, which: int = 0) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]), which)[0])


@dataclass
class Tokens:
    n_bytes: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    inner: np.ndarray
    raw: np.ndarray

    def entries(self) -> list[np.ndarray]:
        """Hashes of every token and of its beginnings; 0 where it is no longer than that."""
        size = self.end - self.start
        out = [span_hashes(self.data, self.start, self.end, 0)]
        for length in BEGINNINGS:
            stop = np.minimum(self.end, self.start + length)
            value = span_hashes(self.data, self.start, stop, 0) ^ np.uint64(
                length * BASES[1] & MASK
            )
            out.append(np.where(size > length, value, np.uint64(0)))
        return out


def tokens_of(column: pa.Array) -> Tokens:
    raw, offsets = text_bytes(column)
    n = len(raw)
    letter = _LETTER[raw]
    inner = _SIGN[raw] > 0
    if n > 2:
        inner[1:-1] &= letter[:-2] & letter[2:]
    if n:
        inner[[0, -1]] = False
    edges = offsets[(offsets > 0) & (offsets < n)]
    inner[edges] = False
    inner[edges - 1] = False
    data = np.where(inner, _SIGN[raw], _LOWER[raw])
    letter |= inner
    before = np.ones(n, dtype=bool)
    before[1:] = ~letter[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.ones(n, dtype=bool)
    after[:-1] = ~letter[1:]
    after[edges - 1] = True
    start = np.flatnonzero(letter & before)
    end = np.flatnonzero(letter & after) + 1
    return Tokens(np.diff(offsets), data, offsets, start, end, np.searchsorted(start, offsets), inner, raw)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def features_of(column: pa.Array, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text. keys: ordered hashes of the lexicon, weights: theirs."""
    t = tokens_of(column)
    n_texts = len(t.first) - 1
    n_tokens = np.maximum(np.diff(t.first), 1)
    n_bytes = np.maximum(t.n_bytes, 1)
    weight = np.zeros(len(t.start))
    entries = t.entries()
    for value in entries:
        at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
        weight = np.maximum(weight, np.where((keys[at] == value) & (value != 0), weights[at], 0))
    strong = weight >= 2.5
    second = np.isin(entries[0], np.array([word_hash(w) for w in SECOND_PERSON], dtype=np.uint64))
    owner = np.repeat(np.arange(n_texts), np.diff(t.first))
    near = np.zeros(len(t.start), dtype=bool)
    for step in range(1, NEAR + 1):
        same = owner[step:] == owner[:-step]
        near[step:] |= second[:-step] & same
        near[:-step] |= second[step:] & same
    upper = (t.raw >= ord("A")) & (t.raw <= ord("Z"))
    ups = np.concatenate([[0], np.cumsum(upper)])
    shouted = (ups[t.end] - ups[t.start] == t.end - t.start) & (t.end - t.start > 1)
    again = np.zeros(len(t.start), dtype=bool)
    again[1:] = (entries[0][1:] == entries[0][:-1]) & (owner[1:] == owner[:-1])
    largest = np.zeros(n_texts)
    np.maximum.at(largest, owner, weight)
    hits = per_text(strong, t.first)
    found = {
        "strong_rate": hits / n_tokens,
        "weight_rate": per_text(weight, t.first) / n_tokens,
        "largest": largest,
        "strong_hits": np.log1p(hits),
        "near_you_rate": per_text(strong & near, t.first) / n_tokens,
        "you_rate": per_text(second, t.first) / n_tokens,
        "capital_rate": per_text(upper, t.offsets) / n_bytes,
        "shouted_rate": per_text(shouted, t.first) / n_tokens,
        "mark_rate": per_text(_MARK[t.raw], t.offsets) / n_bytes,
        "bang_rate": per_text(t.raw == ord("!"), t.offsets) / n_bytes,
        "obfuscated_rate": per_text(t.inner, t.offsets) / n_tokens,
        "log_length": np.log1p(t.n_bytes),
        "weak_rate": per_text((weight > 0) & ~strong, t.first) / n_tokens,
        "repeat_rate": per_text(again, t.first) / n_tokens,
    }
    return np.column_stack([found[name] for name in FEATURES])


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and toxic texts of a task by entry and fold."""
    for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
        t = tokens_of(batch.column("text"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(t.first)).astype(np.uint64)
        toxic = batch.column("toxic").to_numpy() > 0
        fold = batch.column("fold").to_numpy()
        texts, keys = [], []
        for value in t.entries():
            pair = np.unique(np.column_stack([value, owner])[value != 0], axis=0)
            keys.append(pair[:, 0])
            texts.append(pair[:, 1].astype(np.int64))
        key, text = np.concatenate(keys), np.concatenate(texts)
        for k in range(FOLDS):
            own = fold[text] == k
            entry, at = np.unique(key[own], return_inverse=True)
            bad = toxic[text[own]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(entry.view(np.int64)), pa.array(np.full(len(entry), k)),
                 pa.array(np.bincount(at, minlength=len(entry))),
                 pa.array(np.bincount(at, weights=bad, minlength=len(entry)).astype(np.int64))],
                ["entry", "fold", "texts", "toxic"],
            )


def learned_lexicons(labelled: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ordered hashes and weights of the fixed insults, and of entries by log odds in
    labelled(text, toxic, fold): for each fold from the other folds, and last from all."""
    totals = {(k, bad): n for k, bad, n in labelled.groupBy("fold", F.col("toxic") > 0).count().collect()}
    own = [F.col("fold") == k for k in range(FOLDS)] + [F.lit(False)]
    counts = stored(
        labelled.select("text", F.col("toxic").cast("long").alias("toxic"), F.col("fold").cast("long").alias("fold"))
        .mapInArrow(_entry_counts, "entry long, fold long, texts long, toxic long")
        .groupBy("entry")
        .agg(*[
            F.sum(F.when(~left_out, F.col(name))).alias(f"{name}{k}")
            for k, left_out in enumerate(own) for name in ("texts", "toxic")
        ])
        .where(f"toxic{FOLDS} > 0"),
        "toxic-entries",
    )
    out = []
    for k in range(FOLDS + 1):
        bad = sum(n for (fold, toxic), n in totals.items() if toxic and fold != k)
        good = sum(n for (fold, toxic), n in totals.items() if not toxic and fold != k)
        toxic, texts = F.col(f"toxic{k}"), F.col(f"texts{k}")
        weight = F.log((toxic + 0.5) / (bad + 1.0)) - F.log((texts - toxic + 0.5) / (good + 1.0))
        entries = (
            counts.select("entry", weight.alias("weight"), (weight * F.sqrt(toxic)).alias("sure"))
            .where(f"weight > 1.5 AND sure >= {SURE}")
            .orderBy(F.desc("sure"), "entry")
            .limit(ENTRIES)
            .select("entry", "weight")
            .collect()
        )
        out.append(lexicon_of({e & MASK: w for e, w in entries}))
    return out


def lexicon_of(entries: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    entries = {word_hash(word): 3.0 for word in INSULTS} | entries
    keys = np.array(sorted(entries), dtype=np.uint64)
    return keys, np.array([entries[int(k)] for k in keys])


@dataclass
class ToxicityModel:
    keys: np.ndarray
    weights: np.ndarray
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def features(self, rows: DataFrame) -> DataFrame:
        """rows(given: struct with text) with the vector column `features`."""
        keys, weights = self.keys, self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                given = whole.column("given")
                texts = pa.RecordBatch.from_arrays([given, pc.struct_field(given, "text")], ["given", "text"])
                for batch in slices(texts, "text"):
                    values = features_of(batch.column("text"), keys, weights)
                    bounds = pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32())
                    flat = pa.ListArray.from_arrays(bounds, pa.array(values.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("given"), flat], ["given", "flat"])

        schema = T.StructType().add(rows.schema["given"]).add("flat", T.ArrayType(T.DoubleType()))
        return rows.mapInArrow(run, schema).select("given", array_to_vector("flat").alias("features"))

    def score(self, docs: DataFrame) -> DataFrame:
        """docs(text, ...) with score; a column of that name is replaced.

        The given columns travel as one struct, so that none meets the model's own names.
        """
        columns = [c for c in docs.columns if c.lower() != "score"]
        found = self.features(docs.select(F.struct(*columns).alias("given")))
        return self.calibrated(self.raw(found)).select("given.*", "score")

    def raw(self, found: DataFrame) -> DataFrame:
        if self.trees is None:
            hits = F.expm1(vector_to_array("features")[FEATURES.index("strong_hits")])
            return found.withColumn("raw", 1 - 0.95 * F.pow(F.lit(0.55), hits))
        scored = self.trees.transform(found)
        return scored.withColumn("raw", vector_to_array("probability")[1])

    def calibrated(self, scored: DataFrame) -> DataFrame:
        if self.calibration is None:
            return scored.withColumn("score", F.col("raw"))
        # A hundredth of the trees' own order keeps ties of the step function apart.
        return self.calibration.transform(scored).withColumn(
            "score", 0.99 * F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)) + 0.01 * F.col("raw")
        )


def sampled_labels(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, weight) of at most `most` labels of each class; weight: of how many labels
    of its class each stands for."""
    marks = stored(
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(
            "doc_id", (F.col("toxic") > 0).cast("double").alias("toxic"), F.xxhash64("doc_id", F.lit(17)).alias("order")
        ),
        "toxic-marks",
    )
    totals = dict(marks.groupBy("toxic").count().collect())
    parts = [
        marks.where(F.col("toxic") == kind).orderBy("order", "doc_id").limit(most)
        .select("doc_id", "toxic", F.lit(max(totals.get(kind, 0) / most, 1.0)).alias("weight"))
        for kind in (0.0, 1.0)
    ]
    return stored(parts[0].unionByName(parts[1]), "toxic-labels")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """From the texts of docs(doc_id, text) and labels(doc_id, toxic), toxic 1 or 0.

    The labels that are used are few enough to be broadcast, so that no text is shuffled.
    """
    picked = sampled_labels(labels, sample)
    rows = stored(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(picked), "doc_id")
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(FOLDS))),
        "toxic-rows",
    )
    if rows.select("toxic").distinct().count() < 2:
        return ToxicityModel(*lexicon_of({}), None, None)
    *lexicons, (keys, weights) = learned_lexicons(rows)
    parts = [
        ToxicityModel(*lexicon, None, None)
        .features(rows.where(F.col("fold") == k).select(F.struct("text", "toxic", "weight", "fold").alias("given")))
        .select("features", "given.toxic", "given.weight", "given.fold")
        for k, lexicon in enumerate(lexicons)
    ]
    # A small table; a few partitions keep the many small jobs short.
    data = reduce(DataFrame.unionByName, parts).coalesce(2).checkpoint()
    trees = GBTClassifier(
        featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2,
        minInstancesPerNode=5, maxBins=64, seed=7,
    )
    # A fit is many small jobs one after the other, so those of all parts run side by side.
    fold = F.col("fold")
    fitted_on = [data.where(fold != k) for k in range(FOLDS)] + [data]
    with ThreadPool(len(fitted_on)) as pool:
        *others, final = pool.map(inheritable_thread_target(data.sparkSession)(trees.fit), fitted_on)
    held = [
        ToxicityModel(keys, weights, other, None).raw(data.where(fold == k)).select("raw", "toxic", "weight")
        for k, other in enumerate(others)
    ]
    calibration = IsotonicRegression(
        featuresCol="raw", labelCol="toxic", weightCol="weight", predictionCol="calibrated"
    ).fit(reduce(DataFrame.unionByName, held))
    return ToxicityModel(keys, weights, final, calibration)
