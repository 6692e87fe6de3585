"""Queries that score texts by fitted models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.language_model import score_texts
from millrace.llm.toxicity import ToxicityModel, fit_toxicity
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()

#: A score from which a text counts as toxic.
TOXIC = 0.3


def remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> ToxicityModel:
    """Fitted on the labelled rows of docs that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(4) != 2)
    return fit_toxicity(docs, labels)


@registry.query(None)
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_model(spark, sf_dir, docs).score(docs)
    return scored.select(
        "doc_id",
        F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


@registry.query(None)
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, remainder(10) != 0).withColumn(
        "held_out", F.coalesce(remainder(10) == 0, F.lit(False))
    )
