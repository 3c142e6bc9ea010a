"""Data quality: gaps, coverage, regressions, shared pages, domain triage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.predicates import day, page_base


def pricing_kind(tiers: DataFrame) -> DataFrame:
    """conference_id, tiers, zero_tiers: what decides whether an event's prices are a gap."""
    return tiers.groupBy("conference_id").agg(F.count(F.lit(1)).alias("tiers"), F.count_if(F.col("price") == 0).alias("zero_tiers"))


def gaps(conferences: DataFrame, tiers: DataFrame) -> DataFrame:
    """id, gap: a row for each thing that a live event lacks."""
    rows = conferences.filter(~F.col("archived")).join(pricing_kind(tiers).withColumnRenamed("conference_id", "id"), "id", "left")
    offline = ~F.coalesce(F.col("event_format") == "online", F.lit(False))
    found = F.array(
        F.when(F.col("tiers").isNull(), "pricing_none").when(F.col("zero_tiers") == F.col("tiers"), "pricing_zero").when(F.col("zero_tiers") > 0, "pricing_partial"),
        F.when(F.col("start_date").isNull(), "start_date"),
        F.when(F.col("start_date").isNotNull() & F.col("end_date").isNull(), "end_date"),
        F.when(F.col("event_format").isNull(), "event_format"),
        F.when(offline & F.col("city").isNull(), "city"),
        F.when(F.col("event_type").isin("conference", "workshop") & F.col("abstract_open") & F.col("abstract_deadline").isNull() & F.col("abstract_deadline_note").isNull(), "abstract_deadline"),
    )
    return rows.select("id", F.explode(F.array_compact(found)).alias("gap"))


def coverage(conferences: DataFrame, sources: DataFrame, tiers: DataFrame) -> DataFrame:
    """Coverage of every active source and, with a null source_id, of all together. Percentages of nothing are null."""
    priced = tiers.select(F.col("conference_id").alias("id")).distinct().withColumn("priced", F.lit(1))
    live = conferences.filter(~F.col("archived")).join(priced, "id", "left").withColumn("offline", ~F.coalesce(F.col("event_format") == "online", F.lit(False)))
    calls = F.col("event_type").isin("conference", "workshop")
    per = live.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count("priced").alias("priced"),
        F.count_if(calls).alias("calls"),
        F.count_if(calls & F.col("abstract_deadline").isNotNull()).alias("deadlines"),
        F.count_if("offline").alias("located"),
        F.count_if(F.col("offline") & F.col("city").isNotNull()).alias("cities"),
    )
    numbers = ["events", "priced", "calls", "deadlines", "located", "cities"]
    rows = sources.filter("active").select(F.col("id").alias("source_id")).join(per, "source_id", "left").na.fill(0, numbers)
    both = rows.rollup("source_id").agg(*(F.sum(n).alias(n) for n in numbers))
    pct = lambda part, whole, name: F.round(100 * F.try_divide(F.col(part), F.when(F.col(whole) != 0, F.col(whole))), 1).alias(name)
    return both.select("source_id", "events", pct("priced", "events", "fees_pct"), pct("deadlines", "calls", "abstracts_pct"), pct("cities", "located", "city_pct"))


def drops(baseline: DataFrame, current: DataFrame, points: float = 10.0, least: int = 5) -> DataFrame:
    """Metrics of a source that fell by some points or more since the baseline, if it has some events in both."""

    def long(df: DataFrame, name: str) -> DataFrame:
        metrics = "stack(3, 'fees_pct', fees_pct, 'abstracts_pct', abstracts_pct, 'city_pct', city_pct) AS (metric, %s)" % name
        return df.filter((F.col("events") >= least) & F.col("source_id").isNotNull()).selectExpr("source_id", metrics)

    both = long(baseline, "was").join(long(current, "now"), ["source_id", "metric"])
    return both.withColumn("drop", F.round(F.col("was") - F.col("now"), 1)).filter(F.col("drop") >= points)


def confirmed(today: DataFrame, before: DataFrame, events: DataFrame, least: int = 25) -> DataFrame:
    """source_id, metric, drop, red: today's drops; red where the report before had them too and the source has some events, else advice."""
    both = today.join(before.select("source_id", "metric", F.lit(True).alias("again")), ["source_id", "metric"], "left").join(events, "source_id", "left")
    return both.select("source_id", "metric", "drop", (F.coalesce("again", F.lit(False)) & (F.coalesce("events", F.lit(0)) >= least)).alias("red"))


def uncovered(sources: DataFrame, runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """source_id: sources new within some days whose last run failed, or that never ran."""
    recent = sources.filter(F.col("created_on") >= F.date_sub(day(as_of), days)).select(F.col("id").alias("source_id"))
    last = runs.groupBy("source_id").agg(F.max_by("status", F.struct("run_on", "id")).alias("status")).filter(F.col("status") != "failed")
    return recent.join(last, "source_id", "left_anti")


def without_provenance(records: DataFrame, since: str) -> DataFrame:
    """n: records since a day that do not say where they come from."""
    return records.filter((F.col("created_on") >= day(since)) & F.col("identity").isNull()).agg(F.count(F.lit(1)).alias("n"))


def shared_pages(conferences: DataFrame, least: int = 2) -> DataFrame:
    """Pages, without fragments, that some events or more are on."""
    return conferences.filter(~F.col("archived")).groupBy(page_base("source_url").alias("page")).agg(F.count(F.lit(1)).alias("events"), F.min("id").alias("first_id")).filter(F.col("events") >= least)


def completeness(conferences: DataFrame) -> DataFrame:
    """id, score: of what applies to a live event the part that is known, in per cent."""
    offline = ~F.coalesce(F.col("event_format") == "online", F.lit(False))
    checks = [(F.lit(True), F.col("start_date").isNotNull()), (F.lit(True), F.col("end_date").isNotNull()), (F.lit(True), F.col("event_format").isNotNull()), (offline, F.col("city").isNotNull()), (F.col("event_type").isin("conference", "workshop"), F.col("abstract_deadline").isNotNull())]
    applies = sum((a.cast("int") for a, _ in checks), F.lit(0))
    known = sum(((a & k).cast("int") for a, k in checks), F.lit(0))
    return conferences.filter(~F.col("archived")).select("id", F.round(100.0 * known / applies, 1).alias("score"))


def domains(urls: DataFrame, url: str = "url") -> DataFrame:
    """host, pages, first_url: pages by host, without a leading www."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1)), r"^www\.", "")
    return urls.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.min(url).alias("first_url"))


def covered(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """Hosts with the longest known domain that equals or ends them: every host's suffixes meet the known domains in an equi-join."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    long = hosts.select("host", F.explode(suffixes).alias("domain")).join(known.select("domain").distinct(), "domain")
    best = long.groupBy("host").agg(F.max_by("domain", F.length("domain")).alias("domain"))
    return hosts.join(best, "host", "left")
