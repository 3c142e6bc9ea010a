"""Alerts and reminders by watermark, retention of what was sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.predicates import day


def specialty_alerts(profiles: DataFrame, events: DataFrame, as_of: str, cap: int = 50) -> DataFrame:
    """user_id, matched, newest, shown: events of a user's specialty created after the watermark; no watermark means all.

    Events are counted by specialty and day, and answered once for each watermark of a specialty, which users then look
    up: no user meets an event, however many share a specialty. shown counts up to a cap, matched all.
    """
    users = profiles.filter(F.col("specialty").isNotNull() & ~F.col("specialty").isin("", "other")).select("user_id", "specialty", "watermark")
    daily = events.filter(F.col("created_on") <= day(as_of)).groupBy(F.lower("specialty").alias("specialty"), "created_on").agg(F.count(F.lit(1)).alias("n"))
    marks = users.select("specialty", "watermark").distinct().join(daily, "specialty").filter(F.col("watermark").isNull() | (F.col("created_on") > F.col("watermark")))
    told = marks.groupBy("specialty", F.col("watermark").alias("mark")).agg(F.sum("n").alias("n"), F.max("created_on").alias("day"))
    matched = users.join(told.withColumnRenamed("specialty", "field"), (F.col("specialty") == F.col("field")) & F.col("watermark").eqNullSafe(F.col("mark")))
    return matched.groupBy("user_id").agg(F.sum("n").alias("matched"), F.max("day").alias("newest")).withColumn("shown", F.least("matched", F.lit(cap)))


def advance_watermarks(profiles: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """Profiles with the watermark at as_of for those who were told something."""
    told = alerts.select("user_id", F.lit(True).alias("told"))
    return profiles.join(told, "user_id", "left").withColumn("watermark", F.when(F.col("told"), day(as_of)).otherwise(F.col("watermark"))).drop("told")


def due_reminders(reminders: DataFrame, conferences: DataFrame, as_of: str) -> DataFrame:
    """Scheduled reminders that are due, with what becomes of them: sent, or cancelled if the event is gone or archived."""
    known = conferences.select(F.col("id").alias("conference_id"), "archived")
    due = reminders.filter((F.col("status") == "scheduled") & (F.col("scheduled_for") <= day(as_of))).join(known, "conference_id", "left")
    return due.select("id", "user_id", "conference_id", F.when(F.col("archived").isNull() | F.col("archived"), "cancelled").otherwise("sent").alias("outcome"))


def to_purge(sent: DataFrame, as_of: str, column: str, months: int = 12) -> DataFrame:
    """Rows older than some calendar months."""
    return sent.filter(F.col(column) < F.add_months(day(as_of), -months))


def new_reminders(wishes: DataFrame, conferences: DataFrame, existing: DataFrame, as_of: str) -> DataFrame:
    """user_id, conference_id, scheduled_for: each wish (lead in days) some days before its event starts, unless that day is past or the same is scheduled already."""
    starts = conferences.filter("start_date IS NOT NULL").select(F.col("id").alias("conference_id"), "start_date")
    rows = wishes.join(starts, "conference_id").select("user_id", "conference_id", F.date_sub("start_date", F.col("lead")).alias("scheduled_for")).distinct()
    return rows.filter(F.col("scheduled_for") >= day(as_of)).join(existing, ["user_id", "conference_id", "scheduled_for"], "left_anti").select("user_id", "conference_id", "scheduled_for")
