"""What the plans look like at scale: broadcasting off, hot keys forced to be split."""

from __future__ import annotations

import re

import pytest
from paths import MEDIUM, SMALL
from oracle import connect, duck_rows, spark_rows

from millrace.operators.hot import PARTS_CONF, SMALL_KEY_ROWS_CONF
from millrace.operators.ranking import ranked
from millrace.plans import all_queries
from millrace.sources import table
from millrace.streaming.drain import session_conf

QUERIES = {query.name: query for query in all_queries()}
BATCH = [name for name in QUERIES if not name.startswith("streamed_")]
# Queries whose plan depends on whether keys are hot; the bound is set so low that many are.
SPLITTING = [
    "bursts_by_type",
    "event_neighbours",
    "event_percentiles",
    "latest_view_at_purchase",
    "order_ranks",
    "orders_above_customer_average",
    "part_ranks_overall",
    "running_cents_by_type",
    "since_first_event",
    "supplier_price_quartiles",
    "trailing_six_hours",
    "urgent_orders_and_bulk_returns",
    "user_sessions",
]
SPLIT_ALL = {SMALL_KEY_ROWS_CONF: "40", PARTS_CONF: "250"}
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1"}


def plan_of(df) -> str:
    with session_conf(df.sparkSession, {"spark.sql.maxMetadataStringLength": "2000"}):
        return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    with connect(MEDIUM) as con:
        yield con


@pytest.mark.parametrize("name", SPLITTING)
def test_matches_sql_with_keys_split(spark, duck, name):
    query = QUERIES[name]
    with session_conf(spark, {**SPLIT_ALL, **NO_BROADCAST}):
        found = spark_rows(query.build(spark, MEDIUM))
    assert found == duck_rows(duck, query.oracle)[1]


@pytest.mark.parametrize("name", BATCH)
def test_no_products_and_no_large_broadcasts(spark, name):
    """Without Spark's size-checked broadcasts, only tables bounded by construction remain: the
    hot keys and the segments that hold wanted percentiles."""
    with session_conf(spark, NO_BROADCAST):
        plan = plan_of(QUERIES[name].build(spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        assert "BroadcastHashJoin" not in line or "_mark_" in line or "_its_" in line


@pytest.mark.parametrize("name", BATCH)
def test_scans_read_only_some_columns(spark, name):
    """No scan of a wide table reads it whole."""
    plan = plan_of(QUERIES[name].build(spark, SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    assert schemas
    wide = {"lineitem": 11, "events": 6, "orders": 6, "documents": 5}
    for schema in schemas:
        for table, width in wide.items():
            if f"{table[0]}_" in schema or table == "events" and "event_id" in schema:
                assert schema.count(":") < width


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["discounted_lines"].build(spark, SMALL))
    pushed = re.search(r"PushedFilters: \[([^\n]*)\]", plan).group(1)
    for column in ("l_shipdate", "l_discount", "l_quantity", "l_returnflag"):
        assert column in pushed


def test_groups_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["dearest_orders_by_priority"].build(spark, SMALL))
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(QUERIES["dearest_orders"].build(spark, SMALL))


@pytest.mark.parametrize("name", ["running_cents_by_type", "event_neighbours", "order_ranks"])
def test_a_split_window_shuffles_its_rows_once(spark, name):
    """With lead-in rows from one summary, and no join back to the rows."""
    with session_conf(spark, {**SPLIT_ALL, **NO_BROADCAST}):
        plan = plan_of(QUERIES[name].build(spark, MEDIUM))
    assert "Union" in plan
    assert "SortMergeJoin" not in plan


def test_levels_are_counted_only_for_a_dense_rank(spark):
    events = table(spark, MEDIUM, "events").select("event_id", "event_type", "value")
    with session_conf(spark, SPLIT_ALL):
        found = ranked(events, ["event_type"], "value", "event_id")
        with_levels = plan_of(found)
        without = plan_of(found.select("event_id", "row_number", "rank", "cume_dist", "ntile"))
    assert with_levels.count("Exchange hash") == without.count("Exchange hash") + 1


def test_distinct_sketches_are_merged(spark):
    plan = QUERIES["approximate_distinct_counts"].build(spark, SMALL)._jdf.queryExecution().toString()
    assert "hll_union_agg" in plan


def test_no_order_has_a_sketch_of_its_own(spark):
    """Sketches are aggregated by flag and status only; beside a distinct count Spark would keep
    one for each order of a flag."""
    plan = QUERIES["approximate_distinct_counts"].build(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    sketched = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketched
    assert all("keys=[l_returnflag" in line and "l_orderkey" not in line.split("functions=")[0] for line in sketched)


def test_orders_and_flags_without_a_value(spark, tmp_path):
    lines = [(k % 40 if k % 7 else None, [None, "A", "N"][k % 3], "OF"[k % 2], k) for k in range(400)]
    lines += [(None, "R", "O", 1)]
    columns = "l_orderkey long, l_returnflag string, l_linestatus string, n_orders long"
    spark.createDataFrame(lines, columns).repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {tuple(r) for r in QUERIES["approximate_distinct_counts"].build(spark, str(tmp_path)).collect()}
    orders = {flag: {key for key, own, *_ in lines if own == flag and key is not None} for _, flag, *_ in lines}
    assert found == {(flag, len(own), True, True) for flag, own in orders.items()}
