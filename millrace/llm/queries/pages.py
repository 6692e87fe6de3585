"""Queries on web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.html_text import main_texts
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()


@registry.query(None)
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_texts(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
