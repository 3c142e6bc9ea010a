"""Incremental ingest and life cycle: change detection, merging, sweeps. Snapshots in, snapshots out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.predicates import day, degree_title, listing_hash


def with_hash(listing: DataFrame) -> DataFrame:
    """Adds listing_hash over what a listing shows of an event."""
    return listing.withColumn("listing_hash", listing_hash(F.col("name"), F.col("start_date"), F.col("end_date"), F.lit(None).cast("string"), F.when(F.col("is_sold_out"), "1").otherwise("0"), F.col("city"), F.left(F.col("description"), F.lit(300)) if "description" in listing.columns else F.lit("")))


def ingest_actions(shells: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """key, action: insert what is new, update what changed or lacks a field that may now be known, else skip.

    An event without a format, or held in person without a city, is read again even if its listing did not change.
    """
    old = existing.select(key, F.col("listing_hash").alias("old_hash"), "event_format", "city", F.lit(True).alias("known"))
    pending = F.col("event_format").isNull() | ((F.col("event_format") == "in_person") & F.col("city").isNull())
    action = F.when(F.col("known").isNull(), "insert").when(~F.col("listing_hash").eqNullSafe(F.col("old_hash")), "update").when(pending, "heal").otherwise("skip")
    return shells.select(key, "listing_hash").join(old, key, "left").select(key, action.alias("action"))


def hook_candidates(conferences: DataFrame, cap: int = 5) -> DataFrame:
    """Of each source the events whose details are oldest, never-read ones last, up to a cap."""
    order = Window.partitionBy("source_id").orderBy(F.asc_nulls_last("last_detail_on"), "id")
    return conferences.filter(~F.col("archived")).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= cap).select("source_id", "id", "place")


def merge_keeping(old: DataFrame, new: DataFrame, key: str, columns: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both: a new value replaces an old one unless it is null or empty; protected columns are only filled."""

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if dict(new.dtypes)[c] == "string":
            n = F.when(F.trim(n) != "", n)
        return (F.coalesce(o, n) if c in protected else F.coalesce(n, o)).alias(c)

    joined = old.select(key, *columns).alias("o").join(new.select(key, *columns).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *map(pick, columns))


def dedupe_tiers(tiers: DataFrame) -> DataFrame:
    """One tier for each label (without case and a last s), price and currency of an event: the first."""
    label = F.regexp_replace(F.lower("tier_label"), "s+$", "")
    return tiers.groupBy("conference_id", label.alias("label"), "price", "currency").agg(F.min("id").alias("id"))


def conflicting_labels(tiers: DataFrame) -> DataFrame:
    """Tiers whose event has their label at one price only; with more, none of them can be trusted."""
    clear = tiers.groupBy("conference_id", F.lower(F.trim("tier_label")).alias("label")).agg(F.min("price").alias("low"), F.max("price").alias("high")).filter("low = high").select("conference_id", "label")
    return tiers.withColumn("label", F.lower(F.trim("tier_label"))).join(clear, ["conference_id", "label"], "left_semi")


def expired(conferences: DataFrame, as_of: str) -> DataFrame:
    """Live events to archive: ended, or undated at the end but begun; on-demand ones by their start."""
    now, start, end = day(as_of), F.col("start_date"), F.col("end_date")
    reason = F.when(~F.col("is_on_demand") & (end < now), "ended").when(F.col("is_on_demand") & (start < now), "on_demand").when(~F.col("is_on_demand") & end.isNull() & (start < now), "undated_past")
    return conferences.filter(~F.col("archived")).withColumn("reason", reason).filter("reason IS NOT NULL").select("id", "reason")


def stale(conferences: DataFrame, runs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Live events not seen for some days whose source had a good run in that time. A source that fails archives nothing."""
    healthy = runs.filter((F.col("status") == "success") & (F.col("run_on") >= F.date_sub(day(as_of), days)))
    old = conferences.filter(~F.col("archived") & (F.col("last_seen_on") < F.date_sub(day(as_of), days)))
    return old.join(healthy.select("source_id").distinct(), "source_id", "left_semi").select("id", "source_id", "last_seen_on")


def closed_deadlines(conferences: DataFrame, as_of: str) -> DataFrame:
    return conferences.filter(~F.col("archived") & F.col("abstract_open") & (F.col("abstract_deadline") < day(as_of))).select("id", "abstract_deadline")


def recent_statuses(logs: DataFrame, last: int = 3) -> DataFrame:
    """The last runs of each source, newest first."""
    order = Window.partitionBy("source_id").orderBy(F.desc("run_started_at"), F.desc("id"))
    return logs.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= last).select("source_id", "place", "id", "status")


def blocked_streaks(logs: DataFrame, until: str, last: int = 3, days: int = 7) -> DataFrame:
    """Sources whose last runs were all blocked and that had no success within some days."""
    runs = recent_statuses(logs, last).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    good = logs.filter((F.col("status") == "success") & (F.col("run_started_at").cast("date") >= F.date_sub(day(until), days))).select("source_id").distinct()
    return runs.filter((F.col("n") == last) & (F.col("blocked") == last)).join(good, "source_id", "left_anti").select("source_id", "blocked")


def last_success(logs: DataFrame) -> DataFrame:
    """source_id, last_success: when each source last had a good run."""
    return logs.filter(F.col("status") == "success").groupBy("source_id").agg(F.max("run_started_at").alias("last_success"))


def degree_backfill(conferences: DataFrame) -> DataFrame:
    """id, previous, event_type: events whose titles are degrees but whose type is another, with that type."""
    return conferences.filter((F.col("event_type") != "degree") & degree_title("name")).select("id", F.col("event_type").alias("previous"), F.lit("degree").alias("event_type"))
