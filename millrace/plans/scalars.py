"""Scalar, array, JSON and Python functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.money import cents
from millrace.functions.vectorized import WordsWithPlaces, longest_run, smoothed_daily
from millrace.operators.ranking import ranked, top_per_group
from millrace.plans.registry import Registry
from millrace.sources import table

registry = Registry()

# Rows of one chunk of a complete ordered list.
CHUNK = 20


@registry.query("""
    SELECT c_custkey, upper(c_mktsegment) AS upper_segment,
           lower(c_name) AS lower_name, CAST(length(c_name) AS INTEGER) AS n_letters,
           CAST(split_part(c_name, '#', 2) AS BIGINT) AS number_in_name,
           regexp_extract(c_name, '([1-9][0-9]*)$', 1) AS significant_digits,
           regexp_replace(c_name, '0+', '~', 'g') AS squeezed,
           substring(c_mktsegment, 2, 3) AS middle, reverse(c_mktsegment) AS backwards,
           lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded,
           concat_ws('/', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS place,
           translate(c_mktsegment, 'AEIOU', 'aeiou') AS soft_vowels,
           CAST(strpos(c_mktsegment, 'E') AS INTEGER) AS first_e,
           replace(c_name, 'Customer', 'Buyer') AS renamed,
           starts_with(c_mktsegment, 'M') AS starts_with_m,
           regexp_matches(c_name, '7[0-9]$') AS ends_in_seventies,
           md5(c_name) AS fingerprint,
           CAST(levenshtein(c_mktsegment, 'MACHINERY') AS INTEGER) AS edits
    FROM customer
""")
def customer_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    nation = F.col("c_nationkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.upper(segment).alias("upper_segment"),
        F.lower(name).alias("lower_name"),
        F.length(name).alias("n_letters"),
        F.split_part(name, F.lit("#"), F.lit(2)).cast("long").alias("number_in_name"),
        F.regexp_extract(name, "([1-9][0-9]*)$", 1).alias("significant_digits"),
        F.regexp_replace(name, "0+", "~").alias("squeezed"),
        F.substring(segment, 2, 3).alias("middle"),
        F.reverse(segment).alias("backwards"),
        F.lpad(nation, 4, "0").alias("padded"),
        F.concat_ws("/", segment, nation).alias("place"),
        F.translate(segment, "AEIOU", "aeiou").alias("soft_vowels"),
        F.instr(segment, "E").alias("first_e"),
        F.replace(name, F.lit("Customer"), F.lit("Buyer")).alias("renamed"),
        segment.startswith("M").alias("starts_with_m"),
        name.rlike("7[0-9]$").alias("ends_in_seventies"),
        F.md5(name).alias("fingerprint"),
        F.levenshtein(segment, F.lit("MACHINERY")).alias("edits"),
    )


@registry.query("""
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y,
           CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m,
           CAST(day(o_orderdate) AS INTEGER) AS d,
           CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year,
           CAST(week(o_orderdate) AS INTEGER) AS iso_week,
           CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS day_of_week,
           strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
           strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter_start,
           strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start,
           strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
           strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS due,
           strftime(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH, '%Y-%m-%d') AS in_a_quarter,
           CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) AS age_days,
           strftime(o_orderdate, '%d/%m/%Y') AS written
    FROM orders
""")
def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(day).alias("y"),
        F.quarter(day).alias("q"),
        F.month(day).alias("m"),
        F.dayofmonth(day).alias("d"),
        F.dayofyear(day).alias("day_of_year"),
        F.weekofyear(day).alias("iso_week"),
        F.dayofweek(day).alias("day_of_week"),
        _text(F.trunc(day, "month")).alias("month_start"),
        _text(F.trunc(day, "quarter")).alias("quarter_start"),
        _text(F.trunc(day, "week")).alias("week_start"),
        _text(F.last_day(day)).alias("month_end"),
        _text(F.date_add(day, 45)).alias("due"),
        _text(F.add_months(day, 3)).alias("in_a_quarter"),
        F.date_diff(day, F.lit("1995-01-01").cast("date")).alias("age_days"),
        F.date_format(day, "dd/MM/yyyy").alias("written"),
    )


def _text(day: Column) -> Column:
    return day.cast("string")


@registry.query("""
    SELECT event_id, abs(value - 20) AS distance, CAST(ceil(value) AS BIGINT) AS up,
           CAST(floor(value) AS BIGINT) AS down, round(sqrt(abs(value)), 9) AS root,
           round(ln(abs(value) + 1), 9) AS log, round(exp(-abs(value) / 50), 9) AS decay,
           round(pow(abs(value), 1.5), 6) AS power, CAST(sign(value - 20) AS INTEGER) AS side,
           round(sin(value), 9) AS sine, round(atan2(value, 20), 9) AS angle,
           CAST(event_id % 7 AS BIGINT) AS week_slot, greatest(value, 20) AS at_least,
           least(value, 20) AS at_most, CAST(event_id & 12 AS BIGINT) AS bits,
           value / nullif(user_id % 3, 0) AS guarded,
           CAST(CASE WHEN value < 10 THEN 0 WHEN value >= 90 THEN 9
                     ELSE floor((value - 10) / 10) + 1 END AS INTEGER) AS band
    FROM events
""")
def event_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    band = F.floor((value - 10) / 10) + 1
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.abs(value - 20).alias("distance"),
        F.ceil(value).alias("up"),
        F.floor(value).alias("down"),
        F.round(F.sqrt(F.abs(value)), 9).alias("root"),
        F.round(F.ln(F.abs(value) + 1), 9).alias("log"),
        F.round(F.exp(-F.abs(value) / 50), 9).alias("decay"),
        F.round(F.pow(F.abs(value), F.lit(1.5)), 6).alias("power"),
        F.signum(value - 20).cast("int").alias("side"),
        F.round(F.sin(value), 9).alias("sine"),
        F.round(F.atan2(value, F.lit(20.0)), 9).alias("angle"),
        (F.col("event_id") % 7).alias("week_slot"),
        F.greatest(value, F.lit(20.0)).alias("at_least"),
        F.least(value, F.lit(20.0)).alias("at_most"),
        F.col("event_id").bitwiseAND(12).alias("bits"),
        (value / F.nullif(F.col("user_id") % 3, F.lit(0))).alias("guarded"),
        F.when(value < 10, 0).when(value >= 90, 9).otherwise(band).cast("int").alias("band"),
    )


@registry.query("""
    SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events GROUP BY ALL
""")
def totals_by_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k int")
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type", props["k"].alias("k"))
        .agg(F.count("*").alias("n"), F.sum(cents("value")).alias("cents"))
    )


@registry.query("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           '{"id":' || event_id || ',"type":"' || event_type || '"}' AS label
    FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50
""")
def events_with_large_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    label = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    events = table(spark, sf_dir, "events").select("event_id", k.alias("k"), label.alias("label"))
    return events.where("k >= 50")


@registry.query("""
    SELECT word, p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total_size
    FROM (SELECT p_brand, p_size, unnest(string_split(p_name, ' ')) AS word FROM part)
    GROUP BY word, p_brand
""")
def part_words_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(
        "p_brand", "p_size", F.explode(F.split("p_name", " ")).alias("word")
    )
    return words.groupBy("word", "p_brand").agg(
        F.count("*").alias("n"), F.sum("p_size").alias("total_size")
    )


@registry.query("""
    SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY place) AS last_orders
    FROM (SELECT o_custkey, o_orderkey,
                 row_number() OVER (PARTITION BY o_custkey
                                    ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
          FROM orders)
    WHERE place <= 5 GROUP BY o_custkey
""")
def last_orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered list per customer, bounded because only the last five orders go into it."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    last = top_per_group(orders, ["o_custkey"], order, 5, "place")
    ordered = F.array_sort(F.collect_list(F.struct("place", "o_orderkey")))
    keys = F.transform(ordered, lambda entry: entry["o_orderkey"].cast("string"))
    return last.groupBy("o_custkey").agg(F.array_join(keys, ",").alias("last_orders"))


@registry.query("""
    SELECT o_custkey, chunk, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY place) AS orders
    FROM (SELECT o_custkey, o_orderkey, place, (place - 1) // 20 AS chunk
          FROM (SELECT o_custkey, o_orderkey,
                       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place
                FROM orders))
    GROUP BY o_custkey, chunk
""")
def all_orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ordered list of each customer's orders, in numbered chunks of bounded size."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    placed = ranked(orders, ["o_custkey"], "o_orderkey", "o_orderkey").select(
        "o_custkey", "o_orderkey", F.col("row_number").cast("long").alias("place")
    )
    chunk = F.call_function("div", F.col("place") - 1, F.lit(CHUNK))
    ordered = F.array_sort(F.collect_list(F.struct("place", "o_orderkey")))
    keys = F.transform(ordered, lambda entry: entry["o_orderkey"].cast("string"))
    return (
        placed.groupBy("o_custkey", chunk.alias("chunk"))
        .agg(F.array_join(keys, ",").alias("orders"))
    )


@registry.query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
               FROM embeddings)
    SELECT vec_id, CAST(len(e) AS INTEGER) AS n,
           round(list_sum(list_transform(e, lambda x: x * x)), 6) AS square_norm,
           round(list_sum(list_transform(e, lambda x: abs(x))), 6) AS absolute_norm,
           round(list_max(e) - list_min(e), 6) AS spread,
           CAST(len(list_filter(e, lambda x: x > 0)) AS INTEGER) AS n_positive,
           CAST(list_position(e, list_max(e)) AS INTEGER) AS place_of_max,
           len(list_filter(e, lambda x: abs(x) > 0.4)) > 0 AS has_peak,
           round(list_sum(list_transform(list_zip(e[1:len(e) - 1], e[2:len(e)]), lambda p: p[1] * p[2])), 6)
               AS neighbour_product,
           round(list_reverse_sort(e)[3], 6) AS third_largest
    FROM v
""")
def embedding_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    zero = F.lit(0.0)
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")
    )
    # A vector without elements has no products, and one of fewer than three no third.
    pairs = F.greatest(F.size(e) - 1, F.lit(0))
    products = F.zip_with(F.slice(e, 1, pairs), F.slice(e, 2, pairs), lambda x, y: x * y)

    def total(array: Column) -> Column:
        return F.aggregate(array, zero, lambda acc, x: acc + x)

    return vectors.select(
        "vec_id",
        F.size(e).alias("n"),
        F.round(F.aggregate(e, zero, lambda acc, x: acc + x * x), 6).alias("square_norm"),
        F.round(F.aggregate(e, zero, lambda acc, x: acc + F.abs(x)), 6).alias("absolute_norm"),
        F.round(F.array_max(e) - F.array_min(e), 6).alias("spread"),
        F.size(F.filter(e, lambda x: x > 0)).alias("n_positive"),
        F.array_position(e, F.array_max(e)).cast("int").alias("place_of_max"),
        F.exists(e, lambda x: F.abs(x) > 0.4).alias("has_peak"),
        F.round(total(products), 6).alias("neighbour_product"),
        F.round(F.try_element_at(F.sort_array(e, asc=False), F.lit(3)), 6).alias("third_largest"),
    )


@registry.query("""
    WITH signs AS (
        SELECT vec_id, i, sign(embedding[i]) AS s
        FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i)),
    runs AS (
        SELECT vec_id, s, i - row_number() OVER (PARTITION BY vec_id, s ORDER BY i) AS run
        FROM signs),
    lengths AS (SELECT vec_id, count(*) AS n FROM runs GROUP BY vec_id, s, run)
    SELECT vec_id, max(n) AS longest FROM lengths GROUP BY vec_id
""")
def longest_sign_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", longest_run("embedding").alias("longest"))


@registry.query("""
    WITH daily AS (
        SELECT event_type, strftime(ts, '%Y-%m-%d') AS day,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS cents
        FROM events GROUP BY ALL),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM daily)
    SELECT a.event_type, a.day,
           round(sum(b.cents * pow(0.7, a.n - b.n) * CASE WHEN b.n = 1 THEN 1 ELSE 0.3 END), 3)
               AS smoothed
    FROM numbered a JOIN numbered b ON a.event_type = b.event_type AND b.n <= a.n
    GROUP BY a.event_type, a.day
""")
def smoothed_cents_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = (
        table(spark, sf_dir, "events")
        .groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.sum(cents("value")).alias("cents"))
    )
    found = smoothed_daily(daily, "event_type", "day", "cents", 0.3)
    return found.withColumn("smoothed", F.round("smoothed", 3))


@registry.query("""
    SELECT p_partkey, CAST(place AS INTEGER) AS place, word
    FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word,
                 generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part)
""")
def part_words_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return WordsWithPlaces(parts.asTable()).withColumnRenamed("id", "p_partkey")
