"""The splitting window operators against Spark's own windows on skewed rows."""

from __future__ import annotations

import pytest
from paths import MEDIUM, SMALL
from oracle import spark_rows
from pyspark.sql import Window
from pyspark.sql import functions as F
from skew import skewed_events

from millrace.operators.frames import over_neighbours
from millrace.operators.ranking import ranked, top_per_group
from millrace.operators.running import running
from millrace.operators.segments import count_below, plan_split
from millrace.sources import table
from millrace.sources.tables import scratch_path

KEYS = [[], ["user_id"], ["event_type"]]


@pytest.fixture(scope="module")
def events(spark):
    target = scratch_path(spark, "skewed")
    skewed_events(spark, SMALL).write.parquet(target)
    return spark.read.parquet(target)


def test_burst_matches_its_timestamp(events):
    epoch = F.expr("timestamp_ntz '1970-01-01'")
    again = F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01', ts)")
    assert events.where(again != F.col("at")).count() == 0
    assert events.where(F.col("ts") < epoch).count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("points", [(), (3,), (1, 4, 9), tuple(range(0, 200, 3))])
def test_count_below(spark, points, inclusive):
    found = spark.range(-2, 210).select("id", count_below(points, F.col("id"), inclusive).alias("n"))
    for value, n in found.collect():
        assert n == sum(p <= value if inclusive else p < value for p in points)


@pytest.mark.parametrize("parts", [8, 50])
def test_segments_follow_the_order_and_stay_small(events, parts):
    split = plan_split(events, ["user_id"], "at", "event_id", parts=parts, min_rows=10)
    assert split.needed and split.solid
    rows = split.tag(events).where("_hot")
    largest = rows.groupBy("user_id", "_seg", "_sub").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * rows.count() / parts
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    place = F.col("_seg") * 10_000 + F.col("_sub")
    backwards = rows.withColumn("was", F.lag(place).over(order)).where(place < F.col("was"))
    assert backwards.count() == 0


def test_no_hot_key_means_no_split(events):
    assert not plan_split(events, ["event_id"], "at").needed


@pytest.mark.parametrize("parts", [8, 50])
@pytest.mark.parametrize("keys", KEYS)
def test_running(events, keys, parts):
    latest = F.when(F.col("event_type") == "view", F.struct("at", "event_id", "cents"))
    folds = {"total": ("sum", F.col("cents")), "latest": ("best", latest), "n": ("sum", F.lit(1))}
    found = running(events, keys, "at", folds, parts=parts, min_rows=10)
    window = Window.partitionBy(*keys).orderBy("at")
    expected = events.withColumns(
        {
            "total": F.sum("cents").over(window),
            "latest": F.max(latest).over(window),
            "n": F.count("*").over(window),
        }
    )
    assert spark_rows(found) == spark_rows(expected)


def test_running_sums_of_ints_and_decimals_have_room(events):
    """What one segment hands to the next may be too large for the type of the input."""
    price = F.col("cents").cast("decimal(9,2)") * 0 + F.lit("9999999.99").cast("decimal(9,2)")
    folds = {"ints": ("sum", F.lit(2**30)), "decimals": ("sum", price)}
    found = running(events, [], "at", folds, ["event_id"], parts=50, min_rows=10)
    window = Window.partitionBy().orderBy("at")
    expected = events.withColumns(
        {"ints": F.sum(F.lit(2**30)).over(window), "decimals": F.sum(price).over(window)}
    )
    assert found.schema["ints"].dataType == expected.schema["ints"].dataType
    assert found.schema["decimals"].dataType == expected.schema["decimals"].dataType
    assert spark_rows(found) == spark_rows(expected)


@pytest.mark.parametrize("parts", [8, 50])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", ["at", "cents"])
@pytest.mark.parametrize("keys", KEYS)
def test_ranked(events, keys, by, descending, parts):
    found = ranked(events, keys, by, "event_id", descending, tiles=7, parts=parts, min_rows=10)
    direction = F.desc(by) if descending else F.asc(by)
    peers = Window.partitionBy(*keys).orderBy(direction)
    full = Window.partitionBy(*keys).orderBy(direction, "event_id")
    expected = events.withColumns(
        {
            "row_number": F.row_number().over(full),
            "rank": F.rank().over(peers),
            "dense_rank": F.dense_rank().over(peers),
            "percent_rank": F.percent_rank().over(peers),
            "cume_dist": F.cume_dist().over(peers),
            "ntile": F.ntile(7).over(full),
        }
    )
    assert spark_rows(found) == spark_rows(expected)


@pytest.mark.parametrize("before,after", [(3, 0), (0, 2), (4, 3), (0, 0)])
@pytest.mark.parametrize("keys", KEYS)
def test_over_neighbours(events, keys, before, after):
    columns = {"moving": lambda w: F.sum("cents").over(w.rowsBetween(-before, after))}
    if before:
        columns["back"] = lambda w: F.lag("event_id", before).over(w)
    if after:
        columns["ahead"] = lambda w: F.lead("event_id", after).over(w)
    found = over_neighbours(
        events, keys, "at", "event_id", before, after, columns, parts=50, min_rows=10
    )
    window = Window.partitionBy(*keys).orderBy("at", "event_id")
    expected = events.withColumns({name: build(window) for name, build in columns.items()})
    assert spark_rows(found) == spark_rows(expected)


def test_top_per_group_limits_before_the_shuffle(events):
    found = top_per_group(events, ["user_id"], [F.desc("cents"), F.asc("event_id")], 3, "place")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert found.groupBy("user_id").count().agg(F.max("count")).first()[0] == 3


@pytest.mark.parametrize("kind", ["decimal(12,2)", "float", "double"])
def test_split_ranks_by_type_with_nan_infinity_and_null(events, kind):
    value = F.col("cents").cast(kind)
    if kind != "decimal(12,2)":
        odd = F.when(F.col("event_id") % 5 == 0, F.lit("NaN").cast(kind)).when(
            F.col("event_id") % 7 == 0, F.lit("Infinity").cast(kind)
        )
        value = F.coalesce(odd, value)
    rows = events.withColumn("v", F.when(F.col("event_id") % 11 != 0, value))
    split = ranked(rows, ["event_type"], "v", "event_id", parts=20, min_rows=10)
    whole = ranked(rows, ["event_type"], "v", "event_id", parts=20, min_rows=10**9)
    assert spark_rows(split) == spark_rows(whole)


def test_registered_inputs_are_split_without_a_row_floor(spark):
    """The share of the rows alone decides, so the small tables go through the split code too."""
    rows = table(spark, MEDIUM, "events").select("event_id", "event_type", "value")
    assert plan_split(rows, ["event_type"], "value", "event_id").needed
    assert plan_split(rows, [], "value", "event_id").needed
