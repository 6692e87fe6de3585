"""Python functions on executors that do not have this package."""

from __future__ import annotations

import os
import subprocess
import sys

from paths import ROOT, SMALL

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as driver
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[4]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4")
    .getOrCreate()
)

def importable(_):
    import importlib.util
    return importlib.util.find_spec("millrace") is not None

assert spark.sparkContext.parallelize([0]).map(importable).collect() == [False]
queries = driver.queries()
for name in (
    "longest_sign_runs",
    "part_words_with_places",
    "smoothed_cents_by_type",
    "streamed_once_each",
    "streamed_largest_of_day",
):
    assert queries[name](spark, {SMALL!r}).count() > 0, name
assert driver.entry(spark).count() == 5
print("all ran")
"""


def test_python_functions_bring_what_they_need(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert "all ran" in done.stdout, done.stderr[-3000:]
