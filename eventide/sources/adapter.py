"""The event directory's tables, built from the star-schema test tables by arithmetic on their keys.

Each function returns one domain table; ``WITH_SQL`` holds the same rules as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that queries take as today.
AS_OF = "1998-06-01"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = raw(spark, sf_dir, "supplier"), raw(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("source_name"),
        F.when(F.col("s_suppkey") % 11 != 0, F.col("n_name")).alias("society"),
        (F.col("s_acctbal") >= 0).alias("active"),
        F.concat(F.lit("https://"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "-")), F.lit(".example.org/events")).alias("base_url"),
    )


def _choice(key: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def conferences(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """orders: those read in another way, such as a stream, instead of the table."""
    orders = raw(spark, sf_dir, "orders") if orders is None else orders
    customer, nation, region = (raw(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    n_sources = raw(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("start_date", F.when(k % 17 != 0, day))
        .withColumn("shift", ((k % 6) * (k % 9)).cast("int"))
    )
    priority = F.col("o_orderpriority")
    return rows.select(
        k.alias("id"),
        (k % n_sources).alias("source_id"),
        F.concat(F.initcap("c_mktsegment"), F.lit(" "), _choice(k, "Congress", "Course", "Workshop", "MSc in Practice"), F.lit(" "), (k % 97).cast("string")).alias("name"),
        "start_date",
        F.when(k % 5 != 0, F.date_add("start_date", F.col("shift"))).alias("end_date"),
        _choice(k, "conference", "course", "workshop", "degree").alias("event_type"),
        F.when(priority == "1-URGENT", "online").when(priority == "3-MEDIUM", "hybrid").when(priority != "4-NOT SPECIFIED", "in_person").alias("event_format"),
        F.col("c_mktsegment").alias("specialty"),
        F.when(k % 19 != 0, F.col("n_name")).alias("city"),
        F.when(k % 19 != 0, F.col("r_name")).alias("region"),
        (k % 3 == 0).alias("cpd_accredited"),
        (F.col("o_orderstatus") == "O").alias("abstract_open"),
        F.when(k % 4 != 1, F.date_sub("start_date", 45)).alias("abstract_deadline"),
        F.when(k % 10 == 0, F.lit("see the website")).alias("abstract_deadline_note"),
        ((F.col("o_orderstatus") == "P") & (k % 4 == 0)).alias("archived"),
        (k % 13 == 0).alias("is_on_demand"),
        (k % 23 == 0).alias("is_sold_out"),
        day.alias("created_on"),
        F.date_add(day, (k % 60).cast("int")).alias("last_seen_on"),
        F.when(k % 8 != 0, F.date_add(day, (k % 45).cast("int"))).alias("last_detail_on"),
        F.concat(F.lit("https://e"), (k % 50).cast("string"), F.lit(".example.org/event/"), (k % 700).cast("string"), F.when(k % 2 == 0, "#fees").otherwise("")).alias("source_url"),
    )


def pricing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = raw(spark, sf_dir, "lineitem"), raw(spark, sf_dir, "part").select("p_partkey", "p_name")
    price = F.floor(F.col("l_extendedprice") / 100).cast("long")
    return (
        line.filter(F.col("l_orderkey") % 7 != 0)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("conference_id"),
            F.col("p_name").alias("tier_label"),
            F.when(F.col("l_quantity") < 3, F.lit(0).cast("long")).otherwise(price).alias("price"),
            F.when(F.col("l_returnflag") == "A", "GBP").when(F.col("l_returnflag") == "N", "EUR").otherwise("USD").alias("currency"),
            (F.col("l_discount") >= 0.05).alias("is_early_bird"),
        )
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated sessions of courses, from order lines."""
    line = raw(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % 4 == 1)
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("course_id"), F.col("l_shipdate").cast("date").alias("start_date"), (F.col("l_linestatus") == "F").alias("sold_out"))


def scraper_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(raw(spark, sf_dir, "events"))


def runs(events: DataFrame) -> DataFrame:
    """Runs of the crawler, from events read as a table or a stream."""
    kind = F.col("event_type")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("ts").alias("run_started_at"), F.when(kind == "error", "failed").when(kind == "click", "blocked").otherwise("success").alias("status"))


def community_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    field = F.when(kind == "signup", "city").when(kind == "view", "venue_name").when(kind == "purchase", "price").when(kind == "click", "event_format").otherwise("cpd_points")
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 400).alias("conference_id"),
        field.alias("field"),
        F.get_json_object("props", "$.k").alias("value"),
        (F.col("event_id") % 6 != 0).alias("is_published"),
        F.col("ts").cast("date").alias("created_on"),
    )


def dated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs by day, on the calendar of the conferences."""
    return scraper_logs(spark, sf_dir).select("id", "source_id", "status", F.date_sub(F.col("run_started_at").cast("date"), 9358).alias("run_on"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a specialty and the day up to which they were told of new events."""
    c = F.col("c_custkey")
    return raw(spark, sf_dir, "customer").select(c.alias("user_id"), F.when(c % 7 != 0, F.lower("c_mktsegment")).alias("specialty"), F.when(c % 3 != 0, F.date_add(F.lit("1998-01-01").cast("date"), (c % 150).cast("int"))).alias("watermark"))


def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    day = F.date_sub(F.col("ts").cast("date"), 9358)  # 2024 -> 1998
    return raw(spark, sf_dir, "events").select(e.alias("id"), F.col("user_id"), (e * 3 % 20000).alias("conference_id"), day.alias("scheduled_for"), F.when(e % 4 == 0, "sent").otherwise("scheduled").alias("status"))


WITH_SQL = """
WITH sources AS (
  SELECT s_suppkey AS id, s_name AS source_name, CASE WHEN s_suppkey % 11 <> 0 THEN n_name END AS society, s_acctbal >= 0 AS active
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
), conferences AS (
  SELECT o_orderkey AS id, o_orderkey % (SELECT count(*) FROM supplier) AS source_id,
    upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || ['Congress', 'Course', 'Workshop', 'MSc in Practice'][CAST(o_orderkey % 4 AS INT) + 1] || ' ' || CAST(o_orderkey % 97 AS VARCHAR) AS name,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS start_date,
    CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) + CAST((o_orderkey % 6) * (o_orderkey % 9) AS INT) END AS end_date,
    ['conference', 'course', 'workshop', 'degree'][CAST(o_orderkey % 4 AS INT) + 1] AS event_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'online' WHEN '3-MEDIUM' THEN 'hybrid' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'in_person' END AS event_format,
    c_mktsegment AS specialty,
    CASE WHEN o_orderkey % 19 <> 0 THEN n_name END AS city, CASE WHEN o_orderkey % 19 <> 0 THEN r_name END AS region,
    o_orderkey % 3 = 0 AS cpd_accredited, o_orderstatus = 'O' AS abstract_open,
    CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) - 45 END AS abstract_deadline,
    CASE WHEN o_orderkey % 10 = 0 THEN 'see the website' END AS abstract_deadline_note,
    o_orderstatus = 'P' AND o_orderkey % 4 = 0 AS archived, o_orderkey % 13 = 0 AS is_on_demand, o_orderkey % 23 = 0 AS is_sold_out,
    CAST(o_orderdate AS DATE) AS created_on, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS last_seen_on,
    CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) END AS last_detail_on,
    'https://e' || CAST(o_orderkey % 50 AS VARCHAR) || '.example.org/event/' || CAST(o_orderkey % 700 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '#fees' ELSE '' END AS source_url
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), pricing_tiers AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS conference_id, p_name AS tier_label,
    CASE WHEN l_quantity < 3 THEN 0 ELSE CAST(floor(l_extendedprice / 100) AS BIGINT) END AS price,
    CASE l_returnflag WHEN 'A' THEN 'GBP' WHEN 'N' THEN 'EUR' ELSE 'USD' END AS currency, l_discount >= 0.05 AS is_early_bird
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 7 <> 0
), sessions AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS course_id, CAST(l_shipdate AS DATE) AS start_date, l_linestatus = 'F' AS sold_out
  FROM lineitem WHERE l_orderkey % 4 = 1
), scraper_logs AS (
  SELECT event_id AS id, user_id AS source_id, ts AS run_started_at,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'blocked' ELSE 'success' END AS status FROM events
), dated_runs AS (
  SELECT id, source_id, status, CAST(run_started_at AS DATE) - 9358 AS run_on FROM scraper_logs
), community_facts AS (
  SELECT event_id AS id, event_id % 400 AS conference_id,
    CASE event_type WHEN 'signup' THEN 'city' WHEN 'view' THEN 'venue_name' WHEN 'purchase' THEN 'price' WHEN 'click' THEN 'event_format' ELSE 'cpd_points' END AS field,
    props ->> '$.k' AS value, event_id % 6 <> 0 AS is_published, CAST(ts AS DATE) AS created_on FROM events
), profiles AS (
  SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) END AS specialty,
    CASE WHEN c_custkey % 3 <> 0 THEN DATE '1998-01-01' + CAST(c_custkey % 150 AS INT) END AS watermark FROM customer
), reminders AS (
  SELECT event_id AS id, user_id, event_id * 3 % 20000 AS conference_id, CAST(ts AS DATE) - 9358 AS scheduled_for,
    CASE WHEN event_id % 4 = 0 THEN 'sent' ELSE 'scheduled' END AS status FROM events
), cheapest AS (
  SELECT conference_id, min(price) AS price_from, arg_min(currency, row(price, currency, id)) AS price_currency
  FROM pricing_tiers GROUP BY conference_id
), directory AS (
  SELECT c.*, s.society, s.source_name, p.price_from, p.price_currency,
    CASE WHEN event_format = 'online' THEN 'unknown' WHEN regexp_matches(region, '(?i)(england|scotland|wales|northern ireland|^uk$)') THEN 'uk'
      WHEN regexp_matches(city, '(?i)^(london|glasgow|edinburgh|liverpool|manchester|birmingham|cardiff|sheffield|belfast|leeds|bristol)$') THEN 'uk'
      WHEN region IS NULL AND city IS NULL THEN 'unknown' ELSE 'international' END AS country_guess,
    CASE WHEN price_from IS NULL THEN 'unknown' WHEN price_from = 0 THEN 'free' WHEN price_from < 100 THEN 'under-100' WHEN price_from < 300 THEN 'under-300' ELSE 'over-300' END AS price_bucket
  FROM conferences c LEFT JOIN sources s ON s.id = c.source_id LEFT JOIN cheapest p ON p.conference_id = c.id
  WHERE c.archived = FALSE
)
"""
