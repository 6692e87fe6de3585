"""Running a stream over what is there now and reading back what it wrote."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from millrace.sources import scratch_path

# State larger than memory belongs in RocksDB; uploading only its changes keeps commits short.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def session_conf(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Sets session options for the body only; a stream keeps those it was started with."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drain(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Runs an append-mode stream until its source has nothing new; returns its table.

    Results go from the tasks to a parquet table in the shared folder. Its log makes every
    batch count exactly once, also when executors or the driver are lost; a later call with
    the same ``folder`` goes on where this one stopped.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, label)
    with session_conf(spark, STATE_CONF):
        query = (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{folder}/table")
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
