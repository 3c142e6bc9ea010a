"""Registered queries about records on their way in: texts, merging, validation, snapshots, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import money
from eventide.functions import predicates as P
from eventide.functions import texts as T
from eventide.operators import calendar, directory, lifecycle, preview, records, snapshots
from eventide.plans.catalogue import DAY, query
from eventide.sources import adapter as A
from eventide.sources.adapter import AS_OF



def _way(key: Column, *ways: Column | str) -> Column:
    """One of several ways to write something, by a key."""
    return F.element_at(F.array(*(F.lit(w) if isinstance(w, str) else w for w in ways)), (key % len(ways) + 1).cast("int"))


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query(f"""SELECT preset, first, last, (SELECT count(*) FROM directory WHERE start_date <= last AND coalesce(end_date, start_date) >= first) AS events
FROM (VALUES ('this-month', {DAY}, DATE '1998-06-30'), ('next-3-months', {DAY}, DATE '1998-08-31'), ('this-year', {DAY}, DATE '1998-12-31')) t(preset, first, last)""")
def date_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that each preset stands for, and the events on in them, counted in one pass."""
    presets = [(p, *(F.lit(d).cast("date") for d in P.preset_days(p, AS_OF))) for p in ("this-month", "next-3-months", "this-year")]
    on = lambda first, last: F.count_if((F.col("start_date") <= last) & (F.coalesce("end_date", "start_date") >= first))
    counted = A.conferences(spark, sf_dir).filter("NOT archived").agg(*(on(first, last).alias(p) for p, first, last in presets))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(p).alias("preset"), first.alias("first"), last.alias("last"), F.col(f"`{p}`").alias("events")) for p, first, last in presets))))


@query("""SELECT id, name, created_on, price_from, total, place FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY created_on DESC, id) AS place FROM directory
WHERE event_format IN ('online', 'hybrid') AND price_from < 300 AND cpd_accredited AND start_date <= DATE '1998-12-31' AND coalesce(end_date, start_date) >= DATE '1998-06-01') WHERE place BETWEEN 21 AND 40""")
def directory_page_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = directory.from_url("?format=online,hybrid,elsewhere&maxPrice=250&cpd=1&datePreset=this-year&dateFrom=x&sort=newest&page=2&pageSize=20")
    return directory.page(A.conferences(spark, sf_dir), A.sources(spark, sf_dir), A.pricing_tiers(spark, sf_dir), f).select("id", "name", "created_on", "price_from", "total", "place")


@query(f"SELECT id, abstract_deadline FROM directory WHERE abstract_deadline BETWEEN {DAY} AND {DAY} + 60")
def upcoming_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.upcoming(A.conferences(spark, sf_dir).filter("NOT archived"), AS_OF)


@query("""SELECT id, start_date AS first, greatest(start_date, coalesce(end_date, start_date)) AS last FROM directory WHERE start_date <= DATE '1998-07-31' AND greatest(start_date, coalesce(end_date, start_date)) >= DATE '1998-07-01'""")
def events_in_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.in_month(A.conferences(spark, sf_dir).filter("NOT archived"), 1998, 7)


@query(f"""(SELECT 'deadlines' AS feed, id, abstract_deadline AS day FROM directory WHERE specialty IN ('BUILDING', 'FURNITURE') AND abstract_deadline BETWEEN {DAY} AND {DAY} + 30 ORDER BY abstract_deadline, id LIMIT 5)
UNION ALL (SELECT 'new', id, created_on FROM directory WHERE created_on BETWEEN {DAY} - 7 AND {DAY} ORDER BY created_on DESC, id LIMIT 5)
UNION ALL SELECT 'saved', id, start_date FROM directory WHERE id % 50 = 0 AND start_date <= {DAY} + 30 AND coalesce(end_date, start_date) >= {DAY}""")
def dashboard_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's feeds; they have saved the events whose id is divisible by 50."""
    events = A.conferences(spark, sf_dir).filter("NOT archived")
    return preview.feeds(events, events.filter("id % 50 = 0").select("id"), ["BUILDING", "FURNITURE"], AS_OF)


@query("SELECT id, id % 5 IN (0, 1, 2) AS junk FROM conferences")
def junk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conferences(spark, sf_dir).select("id", records.junk_title(_way(F.col("id"), "No results for this search", " ", "Page not found", F.col("name"), _said("On loading: ", F.col("name")))).alias("junk"))


@query("SELECT source_id, max(run_started_at) AS last_success FROM scraper_logs WHERE status = 'success' GROUP BY 1")
def last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.last_success(A.scraper_logs(spark, sf_dir))


@query("SELECT source_url, c.id, string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id) AS tiers FROM conferences c LEFT JOIN pricing_tiers p ON p.conference_id = c.id WHERE source_url LIKE '%/event/17' OR source_url LIKE '%/event/18#fees' GROUP BY 1, 2")
def events_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events on some pages, with the ids of their tiers."""
    events = A.conferences(spark, sf_dir).filter(F.col("source_url").rlike("/event/(17|18#fees)$"))
    return directory.with_tiers(events.select("source_url", "id"), A.pricing_tiers(spark, sf_dir))


@query("SELECT conference_id, string_agg(CAST(price AS VARCHAR) || ' ' || currency, ', ' ORDER BY price, id, currency) AS tiers FROM pricing_tiers GROUP BY 1")
def ordered_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.tier_list(A.pricing_tiers(spark, sf_dir))


@query("SELECT conference_id, count(*) AS tiers, count(*) FILTER (WHERE price = 0) AS zeros, min(tier_label) AS label FROM pricing_tiers GROUP BY 1")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = A.pricing_tiers(spark, sf_dir)
    return tiers.groupBy("conference_id").agg(F.count(F.lit(1)).alias("tiers"), F.count_if(F.col("price") == 0).alias("zeros"), F.min("tier_label").alias("label"))


BATCHES_SQL = """, batches AS (SELECT o_orderkey AS conference_id, ['Member', 'Student'][CAST(n AS INT)] AS tier_label, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 200 * n END AS price, CASE WHEN n = 1 THEN 'EUR' END AS currency,
CASE WHEN o_orderkey % 6 = 0 AND n = 2 THEN 'weak' ELSE 'own_page' END AS evidence_identity, CASE WHEN o_orderkey % 10 <> 0 THEN 'https://x.example.org' ELSE '' END AS evidence_url FROM orders, (VALUES (1), (2)) t(n)),
sound AS (SELECT * FROM batches WHERE conference_id % 6 <> 0 AND conference_id % 10 <> 0)
"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tiers of every order, two of each, some without evidence, price or currency."""
    k = F.col("conference_id")
    rows = A.raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conference_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return rows.select(
        "conference_id",
        F.when(F.col("n") == 1, "Member").otherwise("Student").alias("tier_label"),
        F.when(k % 4 == 0, F.lit(0)).otherwise(k % 200 * F.col("n")).cast("long").alias("price"),
        F.when(F.col("n") == 1, "EUR").alias("currency"),
        F.when((k % 6 == 0) & (F.col("n") == 2), "weak").otherwise("own_page").alias("evidence_identity"),
        F.when(k % 10 != 0, "https://x.example.org").otherwise("").alias("evidence_url"),
    )


@query(BATCHES_SQL + "SELECT conference_id, tier_label, CAST(price AS BIGINT) AS price, coalesce(currency, 'GBP') AS currency FROM sound WHERE conference_id IN (SELECT id FROM conferences) AND conference_id NOT IN (SELECT conference_id FROM pricing_tiers)")
def tiers_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.fill_tiers(A.pricing_tiers(spark, sf_dir), _batches(spark, sf_dir), A.conferences(spark, sf_dir))


@query(BATCHES_SQL + """, weak AS (SELECT conference_id FROM (SELECT conference_id, price, 'Course  Fee' AS tier_label FROM pricing_tiers) GROUP BY 1 HAVING count(*) FILTER (WHERE price = 0) = count(*) OR count(*) = 1)
SELECT conference_id, tier_label, CAST(price AS BIGINT) AS price, currency FROM sound WHERE currency IS NOT NULL AND conference_id IN (SELECT conference_id FROM weak) AND conference_id IN (SELECT conference_id FROM sound WHERE price > 0 AND currency IS NOT NULL)""")
def replaced_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored tier has a label that says nothing."""
    return snapshots.replace_weak_tiers(A.pricing_tiers(spark, sf_dir).withColumn("tier_label", F.lit(" Course  Fee")), _batches(spark, sf_dir))


@query("SELECT s_suppkey AS id, 'old' AS origin FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 3 = 0")
def insert_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which two thirds are known, all sent in twice."""
    every = A.raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return snapshots.insert_new(every.filter("id % 3 <> 0").withColumn("origin", F.lit("old")), every.union(every).withColumn("origin", F.lit("new")), "id")


@query("SELECT id, concat_ws(',', CASE WHEN id % 3 = 0 THEN 'name' END, CASE WHEN id % 4 = 0 AND city IS NOT NULL THEN 'city' END, CASE WHEN id % 5 = 0 AND event_format IS DISTINCT FROM 'hybrid' THEN 'event_format' END) AS fields FROM conferences WHERE fields <> ''")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = A.conferences(spark, sf_dir).select("id", "name", "city", "event_format")
    new = old.select("id", F.when(F.col("id") % 3 == 0, F.upper(F.concat("name", F.lit("!")))).otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 4 != 0, F.col("city")).alias("city"), F.when(F.col("id") % 5 == 0, "hybrid").otherwise(F.col("event_format")).alias("event_format"))
    return snapshots.changed_fields(old, new, "id", ["name", "city", "event_format"])


@query("SELECT id, CASE WHEN (CASE WHEN id % 3 = 0 THEN 'NATION_3' ELSE city END) IS NOT DISTINCT FROM city THEN 'Patched' ELSE city END AS city, (CASE WHEN id % 3 = 0 THEN 'NATION_3' ELSE city END) IS NOT DISTINCT FROM city AS done FROM conferences WHERE id % 2 = 0")
def compare_and_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches for the even ids, of which each third expects one certain city."""
    rows = A.conferences(spark, sf_dir).select("id", "city")
    patches = rows.filter("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "NATION_3").otherwise(F.col("city")).alias("expected"), F.lit("Patched").alias("value"))
    return snapshots.swap(rows, patches, "id", "city")


@query("SELECT course_id, id, FALSE AS fresh FROM sessions WHERE course_id % 3 <> 0 UNION ALL SELECT id, id, TRUE FROM conferences WHERE id % 3 = 0 AND event_type = 'course' AND id IN (SELECT course_id FROM sessions)")
def mirrored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third course was read again, and has one session now."""
    old = A.sessions(spark, sf_dir).select("course_id", "id", F.lit(False).alias("fresh"))
    new = old.filter("course_id % 3 = 0").select("course_id").distinct().select("course_id", F.col("course_id").alias("id"), F.lit(True).alias("fresh"))
    return snapshots.mirror(old, new, "course_id")


@query("SELECT event_id AS id, CASE WHEN user_id <> 7 THEN user_id END AS user_id FROM events WHERE user_id <> 7 OR event_id % 6 <> 0")
def erased_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.raw(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 6 != 0).alias("is_published"))
    return snapshots.erase_user(rows, 7).select("id", "user_id")


@query("SELECT id, CASE WHEN city IS DISTINCT FROM 'NATION_3' THEN city END AS city, CASE WHEN city = 'NATION_3' THEN 'cleared' ELSE 'kept' END AS action FROM conferences WHERE id % 7 = 0")
def repaired_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.conferences(spark, sf_dir)
    return snapshots.repaired_cities(rows, rows.filter("id % 7 = 0").select("id", F.lit("NATION_3").alias("city")))


@query("SELECT id, event_type AS previous, 'degree' AS event_type FROM conferences WHERE event_type <> 'degree' AND id % 11 = 0")
def degree_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose titles turn out to be degrees, with the type that they had."""
    rows = A.conferences(spark, sf_dir).withColumn("name", F.when(F.col("id") % 11 == 0, F.concat(F.lit("PGCert in "), "specialty")).otherwise(F.col("name")))
    return lifecycle.degree_backfill(rows)


@query(f"SELECT id FROM conferences WHERE NOT archived AND (last_detail_on IS NULL OR last_detail_on < {DAY} - 7) AND id NOT IN (SELECT conference_id FROM pricing_tiers)")
def priced_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.priced_late(A.conferences(spark, sf_dir), A.pricing_tiers(spark, sf_dir), AS_OF)


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN 'Full ' || name ELSE name END AS name, start_date, coalesce(end_date, start_date) AS end_date, CASE WHEN id % 3 = 0 THEN 'online' WHEN id % 4 < 3 THEN event_format END AS event_format, CASE WHEN id % 3 <> 0 AND id % 4 < 3 THEN city END AS city, is_sold_out FROM conferences""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of all events and pages of three in four; some pages have no title worth the name."""
    rows = A.conferences(spark, sf_dir)
    listing = rows.select("id", "name", "start_date", F.lit(None).cast("date").alias("end_date"), F.when(F.col("id") % 3 == 0, "Online").alias("hint"), "is_sold_out")
    listing = listing.join(rows.filter("id % 4 = 3").select("id", F.col("end_date").alias("listed")), "id", "left").withColumn("end_date", F.col("listed")).drop("listed")
    page = rows.filter("id % 4 < 3").select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("Full "), "name")).when(F.col("id") % 4 == 1, "Loading ...").alias("name"), "start_date", "end_date", "event_format", "city", F.lit(None).cast("boolean").alias("is_sold_out"))
    return records.merge(listing, page)


@query(f"""SELECT id, id % 9 <> 0 AND source_id IS NOT NULL AS valid, start_date, CASE WHEN id % 6 <> 0 THEN end_date END AS end_date, abstract_deadline, CASE id % 3 WHEN 0 THEN 5 WHEN 1 THEN 4 END AS cpd_points,
abstract_open AND CASE WHEN abstract_deadline IS NOT NULL THEN abstract_deadline >= {DAY} ELSE abstract_deadline_note IS NOT NULL END AS abstract_open, CASE WHEN id % 8 <> 0 THEN event_format END AS event_format, CASE WHEN id % 7 = 0 THEN 'conference' ELSE event_type END AS event_type,
concat_ws(';', CASE WHEN id % 6 = 0 THEN 'end_date is no date' END, CASE WHEN id % 3 = 2 THEN 'cpd_points is no number' END, CASE WHEN abstract_open AND NOT CASE WHEN abstract_deadline IS NOT NULL THEN abstract_deadline >= {DAY} ELSE abstract_deadline_note IS NOT NULL END THEN 'call is not open' END,
CASE WHEN id % 8 = 0 THEN 'unknown format' END, CASE WHEN id % 7 = 0 THEN 'unknown type' END, CASE WHEN start_date IS NULL THEN 'no start_date' END, CASE WHEN city IS NULL THEN 'no city' END) AS warnings FROM conferences""")
def validated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as texts, some of them spoilt."""
    said = lambda c: F.col(c).cast("string").alias(c)
    rows = A.conferences(spark, sf_dir).select("id", F.when(F.col("id") % 9 != 0, F.col("name")).otherwise(" ").alias("name"), "source_id", said("start_date"), F.when(F.col("id") % 6 == 0, "31 May").otherwise(F.col("end_date").cast("string")).alias("end_date"), said("abstract_deadline"), "abstract_deadline_note", "abstract_open", _way(F.col("id"), "4.5", "4.4", "some").alias("cpd_points"), F.when(F.col("id") % 8 == 0, "by post").otherwise(F.col("event_format")).alias("event_format"), F.when(F.col("id") % 7 == 0, "party").otherwise(F.col("event_type")).alias("event_type"), "city")
    return records.validated(rows, AS_OF)


@query("SELECT conference_id, CASE id % 3 WHEN 0 THEN 'Members fee' ELSE tier_label END AS label, price, CASE id % 3 WHEN 1 THEN 'GBP' ELSE currency END AS currency, min(id) AS id FROM pricing_tiers WHERE price > 0 AND price <= 50000 AND id % 4 <> 3 GROUP BY ALL")
def cleaned_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and currencies written in several ways; every fourth tier has none that is known."""
    label = _way(F.col("id"), _said("  Members   fee** - "), _said(F.col("tier_label"), " :"), F.col("tier_label"))
    rows = A.pricing_tiers(spark, sf_dir).withColumn("tier_label", label).withColumn("currency", F.when(F.col("id") % 4 == 3, "unknown").when(F.col("id") % 3 == 1, "£").otherwise(F.lower("currency")))
    return records.clean_tiers(rows)


@query("""SELECT id, concat_ws(',', CASE WHEN start_date IS NULL THEN 'dates' END, CASE WHEN coalesce(event_format, '') <> 'online' AND city IS NULL THEN 'venue' END, CASE WHEN id NOT IN (SELECT conference_id FROM pricing_tiers) THEN 'fees' END,
CASE WHEN abstract_deadline IS NULL AND abstract_deadline_note IS NULL AND NOT abstract_open THEN 'abstracts' END, CASE WHEN NOT cpd_accredited THEN 'cpd' END, 'note') AS sections FROM directory""")
def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.missing_sections(A.conferences(spark, sf_dir).filter("NOT archived"), A.pricing_tiers(spark, sf_dir))


@query(f"""SELECT place, id, bucket FROM (SELECT *, row_number() OVER (ORDER BY bucket, weak, last_detail_on NULLS FIRST, id) AS place FROM (SELECT id, last_detail_on, id % 3 = 0 AS weak, CASE WHEN last_detail_on IS NULL THEN 0 WHEN last_detail_on < {DAY} - 3 THEN 1 ELSE 2 END AS bucket FROM conferences)) WHERE place <= 3000""")
def work_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 3,000 events to mend."""
    return records.work_order(A.conferences(spark, sf_dir).select("id", F.col("last_detail_on").alias("tried_on"), (F.col("id") % 3 == 0).alias("weak")), AS_OF, limit=3000)


@query("""SELECT conference_id, id, label, price FROM (SELECT *, row_number() OVER (PARTITION BY conference_id, head, price ORDER BY parts DESC, id) AS place FROM (SELECT id, conference_id, price % 3 AS price, tier_label || ' · ' || currency || CASE WHEN id % 2 = 0 THEN ' · early' ELSE '' END AS label, tier_label || ' · ' || currency AS head, 2 + CAST(id % 2 = 0 AS INT) AS parts FROM pricing_tiers)) WHERE place = 1""")
def composite_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.col("tier_label"), F.lit(" · "), F.col("currency"), F.when(F.col("id") % 2 == 0, " · early").otherwise(""))
    return records.composite_tiers(A.pricing_tiers(spark, sf_dir).select("id", "conference_id", label.alias("label"), (F.col("price") % 3).alias("price")))


@query("SELECT id, concat_ws('|', specialty, coalesce(city, '-'), name) AS lines FROM conferences")
def lines_without_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = F.coalesce("city", F.lit("-"))
    return A.conferences(spark, sf_dir).select("id", F.array("specialty", "specialty", city, city, city, "name").alias("lines")).select("id", F.array_join(records.without_echoes(F.col("lines")), "|").alias("lines"))


RUNS_SQL = "(SELECT user_id AS source_id, CAST(event_type = 'purchase' AS INT) AS written, CAST(event_type = 'error' AS INT) AS errors, CAST(event_type = 'click' AS INT) AS blocked FROM events WHERE event_id % 97 < 2)"


@query(f"""SELECT source_id, CASE WHEN sum(written) = 0 AND sum(blocked) > 0 THEN 'blocked' WHEN sum(written) = 0 AND sum(errors) > 0 THEN 'failed' WHEN sum(errors) + sum(blocked) > 0 THEN 'partial' ELSE 'success' END AS status, CAST(sum(written) AS BIGINT) AS written FROM {RUNS_SQL} GROUP BY 1""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run took two of 97 of the events, which are its log."""
    kind = lambda k: (F.col("event_type") == k).cast("int")
    rows = A.raw(spark, sf_dir, "events").filter("event_id % 97 < 2")
    return records.run_status(rows.select(F.col("user_id").alias("source_id"), kind("purchase").alias("written"), kind("error").alias("errors"), kind("click").alias("blocked")))


@query("""SELECT source_id, hits, misses, CASE WHEN misses >= 3 THEN 'dropped' WHEN hits >= 3 THEN 'promoted' ELSE 'learning' END AS state FROM (SELECT source_id, count(*) FILTER (WHERE status = 'success') AS hits,
count(*) FILTER (WHERE status <> 'success' AND (last IS NULL OR row(run_started_at, id) > last)) AS misses FROM (SELECT *, max(CASE WHEN status = 'success' THEN row(run_started_at, id) END) OVER (PARTITION BY source_id) AS last FROM scraper_logs) GROUP BY 1)""")
def promoted_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.promotions(A.scraper_logs(spark, sf_dir).select("source_id", "id", F.col("run_started_at").alias("at"), (F.col("status") == "success").alias("hit")))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN 'GBP:' || CAST(price AS VARCHAR) || '.0' WHEN 1 THEN 'EUR:1200.5|EUR:' || CAST(price AS VARCHAR) || '.0|EUR:' || CAST(price AS VARCHAR) || '.0' WHEN 2 THEN 'USD:' || CAST(price AS VARCHAR) || '.0' WHEN 3 THEN 'GBP:' || CAST(price AS VARCHAR) || '.0' ELSE '' END AS amounts FROM pricing_tiers""")
def money_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each price within a sentence, written in one of five ways, the last of them without a currency."""
    p = F.col("price").cast("string")
    said = _way(F.col("id"), _said("Members pay £", p, " in 1998."), _said("From EUR 1.200,50 or ", p, " euros, ", p, " EUR at the door"), _said("Only US$", p, "!"), _said("It is ", p, "GBP for 3 days"), _said("Room ", p, " on 12 May"))
    found = F.transform(money.amounts(said), lambda x: F.concat(x["currency"], F.lit(":"), x["amount"].cast("string")))
    return A.pricing_tiers(spark, sf_dir).select("id", F.array_join(found, "|").alias("amounts"))


@query("SELECT id, CASE WHEN price = 0 THEN 0 WHEN id % 3 = 0 THEN 2 WHEN id % 3 = 1 THEN 1 ELSE 1 END AS n FROM pricing_tiers WHERE price <> 25")
def fee_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fees a sentence names: what is charged for cancellation or parking is none."""
    p = F.col("price").cast("string")
    said = _way(F.col("id"), _said("Fee: £", p, ". Dinner: £", p, ", lunch: £0. Late: EUR ", p), _said("A refund less £25 for cancellation. Fee: £", p), _said("Fee £", p, "\tparking £25"))
    return A.pricing_tiers(spark, sf_dir).filter("price <> 25").select("id", F.size(F.array_distinct(F.transform(money.fees(said), lambda x: F.struct(x["amount"], x["currency"])))).alias("n"))


@query("SELECT id, CASE id % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'CHF' WHEN 3 THEN 'GBP' WHEN 4 THEN 'EUR' END AS currency FROM pricing_tiers")
def currency_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code before a name before a sign before the address."""
    said = _way(F.col("id"), "£100 or EUR 100", "€5 per 100 pounds", "100 chf, £90", "See below", "From € 20 in £", "No price yet")
    url = _way(F.col("id"), "https://a.example.de/x", "https://a.example.de", "https://a.example.de", "https://a.example.uk/p", "https://a.example.uk", "https://a.example.org")
    return A.pricing_tiers(spark, sf_dir).select("id", money.evidence(said, url).alias("currency"))


@query("SELECT id, amount >= 0 AND amount <= CASE currency WHEN 'JPY' THEN 20000000 WHEN 'SEK' THEN 500000 ELSE 50000 END AS ok FROM (SELECT id, price * 400 - 1000 AS amount, ['GBP', 'JPY', 'SEK', 'XXX'][CAST(id % 4 AS INT) + 1] AS currency FROM pricing_tiers)")
def plausible_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pricing_tiers(spark, sf_dir).select("id", money.plausible(F.col("price") * 400 - 1000, _way(F.col("id"), "GBP", "JPY", "SEK", "XXX")).alias("ok"))


@query("SELECT id, CASE WHEN price = 0 THEN 'Free' ELSE CASE currency WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' ELSE 'US$' END || format('{:,}', price) || '.50' END AS label FROM pricing_tiers")
def price_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pricing_tiers(spark, sf_dir).select("id", money.label(F.when(F.col("price") == 0, 0.0).otherwise(F.col("price") + 0.5), F.col("currency")).alias("label"))


@query("SELECT conference_id, currency, n FROM (SELECT *, row_number() OVER (PARTITION BY conference_id ORDER BY n DESC, first_id, currency) AS place FROM (SELECT conference_id, currency, count(*) AS n, min(id) AS first_id FROM pricing_tiers GROUP BY 1, 2)) WHERE place = 1")
def currency_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.majority(A.pricing_tiers(spark, sf_dir), "conference_id", "currency")


@query("SELECT id, CASE id % 5 WHEN 0 THEN '09:30' WHEN 1 THEN '19:05' WHEN 4 THEN '08:00' END AS start FROM conferences")
def start_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conferences(spark, sf_dir).select("id", T.start_time(_way(F.col("id"), "Doors open 9:30 to 17:00", "At 19:05.", "Ratio 12:345", "All day", "From 08:00 (1:2:3)")).alias("start"))


@query("""SELECT id, CASE WHEN start_date IS NULL THEN '' WHEN id % 2 = 0 THEN CAST(start_date AS VARCHAR) || '|' || CAST(start_date + 3 AS VARCHAR) ELSE CAST(start_date AS VARCHAR) END AS days FROM conferences""")
def found_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of a sentence, one or two of them."""
    d, e = F.col("start_date"), F.date_add("start_date", 3)
    said = _way(F.col("id"), _said("On ", F.date_format(d, "d MMMM yyyy"), " until ", F.date_format(e, "MMM d, yyyy"), ", or 31 June 1998"), _said("Held ", F.date_format(d, "dd/MM/yyyy"), " in hall 12/3"))
    return A.conferences(spark, sf_dir).select("id", F.array_join(F.transform(T.all_dates(F.coalesce(said, F.lit(""))), lambda x: x["day"].cast("string")), "|").alias("days"))


@query(f"""SELECT id, CASE id % 5 WHEN 0 THEN coalesce(abstract_deadline >= {DAY}, TRUE) WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE ELSE coalesce(abstract_deadline >= {DAY}, FALSE) END AS open, CASE WHEN id % 5 IN (0, 4) THEN abstract_deadline END AS deadline FROM conferences""")
def submission_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.coalesce(F.date_format("abstract_deadline", "d MMMM yyyy"), F.lit("to be told"))
    said = _way(F.col("id"), _said("Call for papers. Abstract deadline: ", d, "."), _said("Call for abstracts. Submissions are now closed. Deadline: ", d), "Submit your abstract online.", "Come and see.", _said("Submissions close on ", d, " at noon"))
    return A.conferences(spark, sf_dir).select("id", T.submission(said, AS_OF).alias("s")).select("id", "s.open", "s.deadline")


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'online' WHEN 2 THEN 'in_person' END AS form FROM conferences")
def format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conferences(spark, sf_dir).select("id", records.format_of(_way(F.col("id"), "In-person, and a live stream", "Join on Zoom", "Meet us face to face", "Come along")).alias("form"))


@query("SELECT id, id % 3 = 0 AS flagship FROM conferences")
def flagship_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conferences(spark, sf_dir).select("id", _way(F.col("id"), _said(F.col("specialty"), " Annual  Scientific Meeting"), F.col("name"), "Annual fun run").rlike(records.FLAGSHIP).alias("flagship"))


@query("""SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS slug, 'https://x.example.org/#' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '-' || left(md5(name || '|' || coalesce(CAST(start_date AS VARCHAR), '') || '|' || coalesce(city, '')), 8) AS url, CASE WHEN id % 2 = 0 THEN left(name, 12) END AS safe FROM conferences""")
def slugs_and_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name = A.conferences(spark, sf_dir), F.col("name")
    hidden = _way(F.col("id"), _said("\u200b\u202e", name), "\u2060\x07 \n")
    return rows.select("id", T.slug(name).alias("slug"), T.synthetic_url(F.lit("https://x.example.org/"), name, F.col("start_date"), F.col("city")).alias("url"), T.safe_text(hidden, 12).alias("safe"))
