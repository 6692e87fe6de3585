"""Tables between two steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.sources.tables import scratch_path


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Written to the shared folder and read again: lineage is cut and sizes are known.

    batch_rows: rows of one Arrow batch while it is made, for rows that are long.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(BATCH_CONF)
    if batch_rows:
        spark.conf.set(BATCH_CONF, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, before)
    return spark.read.schema(df.schema).parquet(path)
