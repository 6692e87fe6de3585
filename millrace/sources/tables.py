"""Reading the parquet tables, in batch or as a stream, and naming scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(
    spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The table as a file stream; the schema comes from the parquet footers.

    The path is a glob because the file source takes a bare path for a directory, while a
    glob may name either one file or a directory of part files.
    """
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def arriving(df: DataFrame, at: str, pieces: int, files: int, label: str) -> DataFrame:
    """The rows as a stream of files that arrive piece by piece in order of the time `at`.

    The pieces hold about equally many rows. Each is written as `files` files, and as many are
    taken at a time, so that a piece is a micro-batch.
    """
    spark = df.sparkSession
    when = F.unix_micros(F.col(at).cast("timestamp"))
    shares = [k / pieces for k in range(1, pieces)]
    found = df.agg(F.percentile_approx(when, shares, 10_000)).first()[0] if shares else []
    edges = [None, *(found or []), None]
    folder = scratch_path(spark, label)
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (when > low)
        if high is not None:
            inside = inside & (when <= high)
        # Rows without a time come first.
        df.where(F.coalesce(inside, F.lit(k == 0))).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder in the checkpoint folder that the session or its context names.

    Every executor must be able to reach it, so no machine-local default is invented here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{root.rstrip('/')}/millrace/{label}-{uuid.uuid4().hex}"
