"""Teasers, site maps, price and session summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.predicates import day


def home_counters(events: DataFrame, as_of: str) -> DataFrame:
    """One row of counters over the live window, in one aggregation."""
    now = day(as_of)
    live = events.filter(F.col("start_date").isNull() | (F.col("start_date") >= now) | (F.col("end_date") >= now))
    soon = F.col("abstract_deadline").between(now, F.date_add(now, 14))
    return live.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("society").alias("societies"),
        F.count_distinct("specialty").alias("specialties"),
        F.count_if(F.col("price_from") == 0).alias("free"),
        F.count_if(F.col("cpd_accredited")).alias("cpd"),
        F.count_if(soon).alias("closing"),
        F.count_if(F.col("event_format") == "online").alias("online"),
    )


def closing_soon(events: DataFrame, as_of: str, days: int = 14, limit: int = 5) -> DataFrame:
    """The next deadlines of open calls: those within some days, or, if there are none, the next ones at all."""
    now = day(as_of)
    open_calls = events.filter(F.col("abstract_open") & (F.col("abstract_deadline") >= now)).select("id", "name", "abstract_deadline")
    near = open_calls.filter(F.col("abstract_deadline") <= F.date_add(now, days))
    none = near.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    rest = open_calls.crossJoin(none).filter("none").drop("none")  # one row beside each: a scalar, not a product
    return near.unionByName(rest).orderBy("abstract_deadline", "id").limit(limit)


def this_month(events: DataFrame, as_of: str, limit: int = 12) -> DataFrame:
    now = day(as_of)
    rows = events.filter((F.col("start_date") <= F.last_day(now)) & ((F.col("end_date") >= now) | (F.col("end_date").isNull() & (F.col("start_date") >= now))))
    return rows.select("id", "name", "start_date", "end_date").orderBy("start_date", "id").limit(limit)


def top_values(events: DataFrame, column: str, limit: int) -> DataFrame:
    """The most frequent values, by count and then name; null and empty ones left out."""
    rows = events.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "value").limit(limit)


def sitemap(events: DataFrame, limit: int = 5000) -> DataFrame:
    return events.select("id", "last_detail_on").orderBy(F.desc_nulls_last("last_detail_on"), F.desc("id")).limit(limit)


def next_dates(events: DataFrame, as_of: str) -> DataFrame:
    return events.filter((F.col("start_date") >= day(as_of)) & F.col("society").isNotNull()).groupBy("society").agg(F.min("start_date").alias("next_date"))


def price_summary(tiers: DataFrame) -> DataFrame:
    """Each event's price range in one currency: GBP if it has any, else the most frequent one; and how many prices that leaves out."""
    by = tiers.groupBy("conference_id", "currency").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    best = Window.partitionBy("conference_id").orderBy(F.desc(F.col("currency") == "GBP"), F.desc("n"), "first_id", "currency")
    ranked = by.withColumn("place", F.row_number().over(best)).withColumn("all", F.sum("n").over(Window.partitionBy("conference_id")))
    return ranked.filter("place = 1").select("conference_id", "currency", "low", "high", (F.col("all") - F.col("n")).alias("other_count"))


def next_session(sessions: DataFrame, as_of: str) -> DataFrame:
    """Each course's next session that is not sold out, else its next one; with counts of those to come."""
    rows = sessions.filter(F.col("start_date") >= day(as_of))
    pick = F.min(F.struct("sold_out", "start_date", "id"))
    return rows.groupBy("course_id").agg(pick.alias("s"), F.count(F.lit(1)).alias("upcoming"), F.count_if(~F.col("sold_out")).alias("available")).select(
        "course_id", F.col("s.id").alias("session_id"), F.col("s.start_date").alias("start_date"), "upcoming", "available", (F.col("available") == 0).alias("all_sold_out")
    )


def majority(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, column, n: the most frequent value of each key; of equally frequent ones the one whose first id is lowest."""
    counts = rows.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), "first_id", column)).alias("best")).select(key, F.col(f"best.{column}").alias(column), (-F.col("best.less")).alias("n"))


def feeds(events: DataFrame, saved: DataFrame, specialties: list[str], as_of: str, most: int = 5) -> DataFrame:
    """feed, id, day: a user's next deadlines, what is new, and what they saved that is on within 30 days."""
    now = day(as_of)
    due = events.filter(F.col("specialty").isin(*specialties) & F.col("abstract_deadline").between(now, F.date_add(now, 30))).orderBy("abstract_deadline", "id").limit(most).select(F.lit("deadlines").alias("feed"), "id", F.col("abstract_deadline").alias("day"))
    new = events.filter(F.col("created_on").between(F.date_sub(now, 7), now)).orderBy(F.desc("created_on"), "id").limit(most).select(F.lit("new"), "id", "created_on")
    soon = events.join(saved, "id", "left_semi").filter((F.col("start_date") <= F.date_add(now, 30)) & (F.coalesce("end_date", "start_date") >= now)).select(F.lit("saved"), "id", "start_date")
    return due.union(new).union(soon)
