"""From raw documents to packed token windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`; columns that
docs has besides are carried along. Rows with a null doc_id are never taken for toxic copies,
near duplicates or leaks by id, so the filters keep them unless the text itself is toxic; rows
with equal doc_id share one verdict. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontamination import overlaps
from millrace.llm.near_duplicates import near_duplicates
from millrace.llm.packing import pack
from millrace.llm.queries.classifiers import TOXIC, toxicity_model
from millrace.llm.queries.tokens import VOCABULARY
from millrace.llm.scratch import stored
from millrace.llm.substrings import remove_repeated_windows
from millrace.sources import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model scores TOXIC or more."""
    # A column that is called as the model's own goes by another name meanwhile.
    aside = {c: f"_given_{c}" for c in docs.columns if c.lower() == "score"}
    scored = toxicity_model(spark, sf_dir, docs).score(docs.withColumnsRenamed(aside))
    kept = scored.where(F.col("score") < TOXIC).drop("score")
    return kept.withColumnsRenamed({there: here for here, there in aside.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    repeated = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(stored(repeated, "pipeline-repeated"), "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 13-word windows of earlier documents; texts of which no word is left go."""
    cut = remove_repeated_windows(docs).where("n_removed = 0 OR n_removed < n_words")
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
        cut = cut.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return cut.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    found = overlaps(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaks = stored(found.select("doc_id").where("doc_id IS NOT NULL").distinct(), "pipeline-leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows with their ids."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: None of the stages' models and vocabularies can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
