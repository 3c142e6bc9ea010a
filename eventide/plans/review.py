"""Registered queries about what is reviewed: audits, contributions, the taxonomy, alerts, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators import alerts, audit, calendar, moderation, quality, search, taxonomy
from eventide.plans.catalogue import COVERAGE_SQL, DAY, TAXONOMY, query
from eventide.sources import adapter as A
from eventide.sources.adapter import AS_OF



def _way(key: Column, *ways: Column | str) -> Column:
    return F.element_at(F.array(*(F.lit(w) if isinstance(w, str) else w for w in ways)), (key % len(ways) + 1).cast("int"))


PAGE = ["Abstracts close soon. Fee: £250.", "Held on 3 May 1998 and 5 May 1998, with 12 CPD points.", "It takes place at the Great Hall of Anywhere.", "Nothing to see."]
ABOUT = ["A long account of what goes on there, with a word of {} in it.", "Login to read more about this and about all of our other meetings.", "Short.", ""]
AUDIT_SQL = """, k AS (SELECT conference_id, count(*) AS tiers, count(*) FILTER (WHERE price = 0) AS zeros FROM pricing_tiers GROUP BY 1), e AS (SELECT c.*, coalesce(tiers, 0) AS tiers, zeros, id % 4 AS w, contains(lower(name), 'msc') AS plain FROM conferences c LEFT JOIN k ON conference_id = id WHERE NOT archived),
found AS (SELECT id, source_id, 'description' AS field, CASE w WHEN 3 THEN 'MISSING' WHEN 2 THEN 'SUSPECT' WHEN 1 THEN 'SUSPECT' ELSE 'OK' END AS verdict FROM e
UNION ALL SELECT id, source_id, 'start_date', CASE WHEN start_date IS NOT NULL THEN 'OK' WHEN w = 1 THEN 'MISSING' ELSE 'GENUINELY_ABSENT' END FROM e
UNION ALL SELECT id, source_id, 'end_date', CASE WHEN end_date IS NOT NULL THEN 'OK' WHEN w = 1 THEN 'MISSING' ELSE 'GENUINELY_ABSENT' END FROM e
UNION ALL SELECT id, source_id, 'city', CASE WHEN city IS NOT NULL THEN 'OK' WHEN event_format = 'online' THEN 'NOT_APPLICABLE' ELSE 'MISSING' END FROM e
UNION ALL SELECT id, source_id, 'venue_name', CASE WHEN event_format = 'online' THEN 'NOT_APPLICABLE' WHEN w = 2 THEN 'MISSING' ELSE 'GENUINELY_ABSENT' END FROM e
UNION ALL SELECT id, source_id, 'event_format', CASE WHEN event_format IS NULL THEN 'MISSING' ELSE 'OK' END FROM e
UNION ALL SELECT id, source_id, 'is_flagship', 'OK' FROM e
UNION ALL SELECT id, source_id, 'cpd_points', CASE WHEN id % 3 = 0 THEN 'OK' WHEN w = 1 THEN 'MISSING' ELSE 'GENUINELY_ABSENT' END FROM e
UNION ALL SELECT id, source_id, 'abstract_status', CASE WHEN event_type NOT IN ('conference', 'workshop') THEN 'NOT_APPLICABLE' WHEN w = 0 AND abstract_deadline IS NULL AND abstract_deadline_note IS NULL THEN 'MISSING' WHEN w <> 0 AND abstract_open THEN 'SUSPECT' ELSE 'OK' END FROM e
UNION ALL SELECT id, source_id, 'pricing', CASE WHEN tiers > 0 AND zeros = tiers AND w = 0 THEN 'SUSPECT' WHEN tiers > 0 THEN 'OK' WHEN w = 0 THEN 'MISSING' ELSE 'GENUINELY_ABSENT' END FROM e),
scored AS (SELECT id, source_id, round(100.0 * count(*) FILTER (WHERE verdict IN ('OK', 'GENUINELY_ABSENT')) / count(*) FILTER (WHERE verdict <> 'NOT_APPLICABLE'), 1) AS score, count(*) FILTER (WHERE verdict IN ('SUSPECT', 'MISSING')) = 0 AS passes FROM found GROUP BY 1, 2)
"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts on every live event, with pages and accounts of four kinds."""
    rows = A.conferences(spark, sf_dir).filter("NOT archived")
    about = F.when(F.col("id") % 4 == 0, F.replace(F.lit(ABOUT[0]), F.lit("{}"), F.lower("name"))).otherwise(_way(F.col("id"), *ABOUT))
    events = rows.withColumn("description", about).withColumn("is_flagship", F.lit(False)).withColumn("cpd_points", F.when(F.col("id") % 3 == 0, 5))
    return audit.verdicts(events, rows.select("id", _way(F.col("id"), *PAGE).alias("page_text")), A.pricing_tiers(spark, sf_dir))


@query(AUDIT_SQL + "SELECT id, source_id, field, verdict FROM found")
def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query(AUDIT_SQL + "SELECT id, source_id, score, passes FROM scored")
def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scores(_found(spark, sf_dir)).withColumn("score", F.col("score").cast("double"))


@query(AUDIT_SQL + ", t AS (SELECT source_id, count(*) AS events, count(*) FILTER (WHERE passes) AS passed, CAST(sum(CAST(score * 10 AS BIGINT)) AS BIGINT) AS points FROM scored GROUP BY 1) SELECT * FROM t")
def audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.scores(_found(spark, sf_dir))
    points = rows.groupBy("source_id").agg(F.sum((F.col("score") * 10).cast("long")).alias("points"))
    return audit.sources(rows).drop("average").join(points, "source_id")


@query(AUDIT_SQL + "SELECT source_id, count(*) FILTER (WHERE verdict = 'OK') AS ok, count(*) FILTER (WHERE verdict = 'SUSPECT') AS suspect, count(*) FILTER (WHERE verdict = 'MISSING') AS missing, count(*) FILTER (WHERE verdict = 'GENUINELY_ABSENT') AS genuinely_absent FROM found GROUP BY 1")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counted(_found(spark, sf_dir))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'UNKNOWN' WHEN id % 3 = 0 THEN 'WRONG_FREE' WHEN id % 3 = 1 THEN 'LEGIT_FREE' ELSE 'UNKNOWN' END AS verdict FROM conferences")
def zero_tier_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event's evidence is one text that they all show."""
    text = F.when(F.col("id") % 5 == 0, "the same for all").otherwise(F.concat(F.lit("own "), F.col("id").cast("string")))
    rows = A.conferences(spark, sf_dir).select("id", text.alias("text"), audit.free_verdict(F.col("id") % 3 == 0, F.col("id") % 3 == 1).alias("verdict"))
    return audit.shared_evidence(rows)


@query("""SELECT id, concat_ws(';', CASE WHEN id % 7 = 0 THEN 'url' END, CASE WHEN id % 11 = 0 THEN 'name' END, CASE WHEN id % 3 = 0 THEN 'points' END, CASE WHEN id % 5 = 0 THEN 'format' END, CASE WHEN id % 2 = 0 THEN 'price' END, CASE WHEN id % 13 = 0 THEN 'end_date' END,
CASE WHEN id % 13 <> 0 AND id % 4 = 1 AND start_date IS NOT NULL THEN 'order' END) AS errors FROM conferences""")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as if sent in, with slips."""
    rows = A.conferences(spark, sf_dir)
    end = F.when(F.col("id") % 13 == 0, "1998-02-30").when(F.col("id") % 4 == 1, F.date_sub("start_date", 1).cast("string")).otherwise(F.col("start_date").cast("string"))
    return moderation.payload_errors(rows.select("id", F.when(F.col("id") % 7 == 0, "javascript:x").otherwise("https://a.example.org/").alias("booking_url"), F.when(F.col("id") % 11 == 0, F.repeat(F.lit("x"), 201)).otherwise(F.col("name")).alias("name"), "city", F.when(F.col("id") % 3 == 0, "501").otherwise("12").alias("cpd_points"), F.when(F.col("id") % 5 == 0, "post").otherwise("online").alias("event_format"), F.when(F.col("id") % 2 == 0, "100000.5").otherwise("99.5").alias("from_price"), F.col("start_date").cast("string").alias("start_date"), end.alias("end_date")))


CONTRIBUTIONS_SQL = """, contributions AS (SELECT event_id AS id, user_id, ['pending', 'needs_info', 'published', 'merged', 'rejected', 'hidden', 'expired'][CAST(event_id % 7 AS INT) + 1] AS status, ['checked', 'waiting', 'skipped', 'failed'][CAST(event_id % 4 AS INT) + 1] AS check_status,
CASE WHEN event_id % 3 <> 0 THEN event_id % 400 END AS conference_id, CAST(ts AS DATE) - 9345 AS created_on, event_type AS kind FROM events)
"""


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return A.raw(spark, sf_dir, "events").select(
        e.alias("id"), "user_id", _way(e, "pending", "needs_info", "published", "merged", "rejected", "hidden", "expired").alias("status"), _way(e, "checked", "waiting", "skipped", "failed").alias("check_status"),
        F.when(e % 3 != 0, e % 400).alias("conference_id"), F.date_sub(F.col("ts").cast("date"), 9345).alias("created_on"), F.col("event_type").alias("kind"),
    )


@query(CONTRIBUTIONS_SQL + "SELECT id, user_id, 'pending' AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_on, id) AS place FROM contributions) WHERE place <= 10")
def admitted_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.admitted(_contributions(spark, sf_dir))


@query(CONTRIBUTIONS_SQL + """, a AS (SELECT *, ['approve', 'merge', 'needs_info', 'reject', 'hide', 'burn'][CAST(id % 6 AS INT) + 1] AS action, id % 5 = 0 AS confirmed FROM contributions WHERE id % 2 = 0 OR id % 3 = 0),
w AS (SELECT *, CASE WHEN action = 'burn' THEN 'unknown action' WHEN action = 'hide' AND status NOT IN ('published', 'merged') THEN 'not public' WHEN action <> 'hide' AND status NOT IN ('pending', 'needs_info') THEN 'closed'
WHEN action IN ('approve', 'merge') AND check_status = 'skipped' THEN 'unsafe link' WHEN action IN ('approve', 'merge') AND check_status = 'waiting' AND NOT confirmed THEN 'unchecked link' WHEN action = 'merge' AND conference_id IS NULL THEN 'no event' END AS why FROM a)
SELECT id, CASE WHEN why IS NOT NULL THEN status ELSE CASE action WHEN 'approve' THEN 'published' WHEN 'merge' THEN 'merged' WHEN 'needs_info' THEN 'needs_info' WHEN 'reject' THEN 'rejected' ELSE 'hidden' END END AS status, why IS NULL AS done, why FROM w""")
def moderation_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contributions(spark, sf_dir)
    actions = rows.filter("id % 2 = 0 OR id % 3 = 0").select("id", _way(F.col("id"), "approve", "merge", "needs_info", "reject", "hide", "burn").alias("action"), (F.col("id") % 5 == 0).alias("confirmed"))
    return moderation.moderated(rows, actions)


@query(CONTRIBUTIONS_SQL + "SELECT CASE WHEN status = 'merged' THEN 'published' ELSE status END AS tab, count(*) AS n FROM contributions GROUP BY 1")
def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.tabs(_contributions(spark, sf_dir))


@query(CONTRIBUTIONS_SQL + "SELECT kind, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'published') AS published, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) AS n FROM contributions GROUP BY 1")
def moderation_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.breakdown(_contributions(spark, sf_dir))


@query(CONTRIBUTIONS_SQL + f"""SELECT s_suppkey AS admin_id, waiting, oldest FROM supplier, (SELECT count(*) AS waiting, min(created_on) AS oldest FROM contributions WHERE status = 'pending' AND created_on >= {DAY} - 30)
WHERE waiting > 0 AND CASE WHEN s_suppkey % 3 = 0 THEN waiting WHEN s_suppkey % 3 = 1 THEN 1 END IS DISTINCT FROM waiting""")
def moderation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the moderators have an old notice unread; nobody has that of today."""
    rows, key = _contributions(spark, sf_dir), F.col("s_suppkey")
    n = rows.filter((F.col("status") == "pending") & (F.col("created_on") >= F.date_sub(F.lit(AS_OF).cast("date"), 30))).agg(F.count(F.lit(1))).scalar()
    admins = A.raw(spark, sf_dir, "supplier").select(key.alias("admin_id"), F.when(key % 3 == 0, n).when(key % 3 == 1, F.lit(1)).cast("long").alias("unread"))
    return moderation.digest(rows, admins, AS_OF)


@query(CONTRIBUTIONS_SQL + """SELECT conference_id, field, arg_max(value, id) AS value FROM (SELECT id, conference_id, 'city' AS field, 'Town ' || CAST(id % 9 AS VARCHAR) AS value FROM contributions WHERE id % 4 <> 0 UNION ALL SELECT id, conference_id, 'cpd_points', CAST(id % 30 AS VARCHAR) FROM contributions WHERE id % 5 <> 0)
WHERE conference_id IS NOT NULL GROUP BY 1, 2""")
def published_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("city"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("Town "), (F.col("id") % 9).cast("string"))), F.lit("cpd_points"), F.when(F.col("id") % 5 != 0, (F.col("id") % 30).cast("string")).otherwise(""), F.lit("secret"), F.lit("x"))
    return moderation.facts_of(_contributions(spark, sf_dir).filter("conference_id IS NOT NULL").select("id", "conference_id", fields.alias("fields")))


@query("""SELECT id AS conference_id, 'Member' AS label, CAST(id % 90 AS BIGINT) AS price, CASE WHEN id % 2 = 0 THEN 'EUR' ELSE 'GBP' END AS currency FROM conferences WHERE id % 3 = 0 UNION ALL SELECT id, 'Standard', id % 70, CASE WHEN id % 2 = 0 THEN 'EUR' ELSE 'GBP' END FROM conferences WHERE id % 3 <> 2""")
def tiers_from_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees in two tiers, the second without a label; or only a lowest price; or nothing."""
    tier = lambda label, price: F.struct(F.lit(label).cast("string").alias("label"), price.cast("long").alias("price"))
    none = F.lit(None).cast("long")
    tiers = F.when(F.col("id") % 3 == 0, F.array(tier(" Member ", F.col("id") % 90), tier(" ", F.col("id") % 70), tier("Free", none))).otherwise(F.array(tier("Free", none)))
    return moderation.tiers_of(A.conferences(spark, sf_dir).select(F.col("id").alias("conference_id"), F.when(F.col("id") % 2 == 0, "EUR").alias("currency"), tiers.alias("tiers"), F.when(F.col("id") % 3 != 2, (F.col("id") % 70).cast("long")).alias("from_price")))


@query("SELECT id, CASE id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE END AS city, CASE WHEN id % 3 = 0 THEN TRUE WHEN id % 3 = 1 THEN FALSE END AS prices FROM conferences")
def enrichment_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, found = _way(F.col("id"), " New   York", "Paris", "Rome", " "), _way(F.col("id"), "new york ", "London", F.lit(None).cast("string"), "Oslo")
    prices = _way(F.col("id"), F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(9)), F.array().cast("array<int>"))
    return A.conferences(spark, sf_dir).select("id", moderation.agrees(given, found).alias("city"), moderation.prices_agree(prices, F.array(F.lit(1), F.lit(2), F.lit(3))).alias("prices"))


@query("""SELECT id, 'city' AS field, CASE WHEN id % 3 = 0 THEN 'Here' ELSE 'There' END AS final, id % 3 <> 0 AS from_site, id % 6 = 0 AS disagrees FROM conferences WHERE id % 3 = 0 OR id % 2 = 0""")
def field_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.conferences(spark, sf_dir)
    return moderation.review(rows.filter("id % 3 = 0").select("id", F.lit("city").alias("field"), F.lit("Here").alias("value")), rows.filter("id % 2 = 0").select("id", F.lit("city").alias("field"), F.lit("There").alias("value")))


@query(CONTRIBUTIONS_SQL + "SELECT id, id % 5 = 0 AS mismatch, NOT (id % 60 < 50) AS unseen FROM contributions")
def link_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.lit("e"), (F.col("id") % 60).cast("string"), F.lit(".example.org"))
    rows = _contributions(spark, sf_dir).select("id", F.concat(F.lit("https://www."), host, F.lit("/x")).alias("organiser_url"), F.when(F.col("id") % 5 == 0, "https://shop.example.net").otherwise(F.concat(F.lit("HTTP://"), F.upper(host))).alias("booking_url"))
    return moderation.link_signals(rows, A.conferences(spark, sf_dir))


TAXONOMY_SQL = """, taxonomy(raw, parent) AS (VALUES ('BUILDING', 'works'), ('Machinery', 'works'), ('FURNITURE', 'home'), ('household', 'home'))
"""
SOCIETIES = [("NATION_3", "Society of France", "college", "France"), ("NATION_5", "Society of Japan", "society", "Japan"), ("NATION_7", "College of Kenya", "college", "Kenya")]
SOCIETIES_SQL = ", societies(code, name, kind, country) AS (VALUES " + ", ".join(map(str, SOCIETIES)) + ")\n"


def _taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "raw string, parent string")


def _societies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOCIETIES, "code string, name string, kind string, country string")


@query("""SELECT slug, CASE slug WHEN 'works' THEN 'BUILDING,Machinery' WHEN 'home' THEN 'FURNITURE,household' ELSE '' END AS raws, count(*) AS events FROM (
  SELECT CASE lower(specialty) WHEN 'building' THEN 'works' WHEN 'machinery' THEN 'works' WHEN 'furniture' THEN 'home' WHEN 'household' THEN 'home' ELSE lower(specialty) END AS slug FROM conferences) GROUP BY 1""")
def expanded_specialties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents of all events' specialties, or these themselves where the taxonomy has none, with what each stands for and its events."""
    raws = _taxonomy(spark).select(F.lower("raw").alias("key"), "parent")
    events = A.conferences(spark, sf_dir).groupBy(F.lower("specialty").alias("key")).agg(F.count(F.lit(1)).alias("events"))
    named = events.join(raws, "key", "left").groupBy(F.coalesce("parent", "key").alias("slug")).agg(F.sum("events").alias("events"))
    return taxonomy.expand(named.select("slug"), _taxonomy(spark)).join(named, "slug")


@query(TAXONOMY_SQL + """SELECT user_id, CASE WHEN specialty IN ('building', 'machinery') THEN 'BUILDING,Machinery' WHEN specialty IN ('furniture', 'household') THEN 'FURNITURE,household' ELSE '' END AS raws FROM profiles""")
def profile_specialties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.of_profiles(A.profiles(spark, sf_dir), _taxonomy(spark))


@query("SELECT user_id, n AS events FROM profiles JOIN (SELECT lower(specialty) AS s, count(*) AS n FROM directory GROUP BY 1) ON s = specialty WHERE specialty = 'automobile'")
def unmapped_specialties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.unmapped(A.profiles(spark, sf_dir), _taxonomy(spark), A.conferences(spark, sf_dir).filter("NOT archived"))


@query(SOCIETIES_SQL + "SELECT n_name AS code, coalesce(name, n_name) AS name, coalesce(kind, 'other') AS kind, coalesce(country, 'Unknown') AS country FROM nation LEFT JOIN societies ON code = n_name")
def society_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.info(A.raw(spark, sf_dir, "nation").select(F.col("n_name").alias("code")), _societies(spark))


@query(SOCIETIES_SQL + "SELECT coalesce(kind, 'other') AS kind, string_agg(coalesce(name, n_name), ',' ORDER BY coalesce(name, n_name)) AS names FROM nation LEFT JOIN societies ON code = n_name GROUP BY 1")
def societies_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.by_kind(A.raw(spark, sf_dir, "nation").select(F.col("n_name").alias("code")), _societies(spark))


@query(SOCIETIES_SQL + "SELECT id AS source_id, society FROM sources WHERE active AND society NOT IN (SELECT code FROM societies)")
def unknown_societies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.missing(A.sources(spark, sf_dir), _societies(spark))


@query(", counts AS (SELECT society, count(*) AS n FROM directory WHERE society IS NOT NULL GROUP BY 1) SELECT society, n, CASE society WHEN 'NATION_5' THEN 2 ELSE 3 END AS place FROM counts WHERE society IN ('NATION_5', 'NATION_3')")
def featured_societies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.conferences(spark, sf_dir).filter("NOT archived").join(A.sources(spark, sf_dir).select(F.col("id").alias("source_id"), "society"), "source_id")
    counts = rows.filter("society IS NOT NULL").groupBy("society").agg(F.count(F.lit(1)).alias("n"))
    return taxonomy.featured(counts, ["ATLANTIS", "NATION_5", "NATION_3"])


@query(COVERAGE_SQL + """, d AS (SELECT source_id, metric, value, events FROM (UNPIVOT (SELECT source_id, events, fees_pct, abstracts_pct, city_pct FROM coverage WHERE events >= 5 AND source_id IS NOT NULL) ON fees_pct, abstracts_pct, city_pct INTO NAME metric VALUE value))
SELECT source_id, metric, source_id % 2 = 0 AND events >= 25 AS red FROM d WHERE source_id % 4 <> 3""")
def confirmed_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots: the first is whole, the second lacks what even sources said, and today's what all but every fourth one did."""
    first = quality.coverage(A.conferences(spark, sf_dir), A.sources(spark, sf_dir), A.pricing_tiers(spark, sf_dir))
    without = lambda gone: first.select("source_id", "events", *(F.when(gone & F.col(c).isNotNull(), F.col(c) - 200).otherwise(F.col(c)).alias(c) for c in ("fees_pct", "abstracts_pct", "city_pct")))
    s = F.col("source_id")
    found = quality.confirmed(quality.drops(first, without(s % 4 != 3)), quality.drops(first, without(s % 2 == 0)), first.filter("source_id IS NOT NULL").select("source_id", "events"))
    return found.select("source_id", "metric", "red")


@query(f"""SELECT s_suppkey AS source_id FROM supplier LEFT JOIN (SELECT source_id, arg_max(status, row(run_on, id)) AS status FROM dated_runs GROUP BY 1) ON source_id = s_suppkey WHERE s_suppkey % 20 <= 7 AND coalesce(status, 'failed') = 'failed'""")
def uncovered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are as many days old as their id leaves by 20."""
    key = F.col("s_suppkey")
    rows = A.raw(spark, sf_dir, "supplier").select(key.alias("id"), F.date_sub(F.lit(AS_OF).cast("date"), (key % 20).cast("int")).alias("created_on"))
    return quality.uncovered(rows, A.dated_runs(spark, sf_dir), AS_OF)


@query(f"SELECT count(*) AS n FROM conferences WHERE created_on >= DATE '1998-01-01' AND id % 9 = 0")
def provenance_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of the year have no evidence of where they come from."""
    rows = A.conferences(spark, sf_dir).select("created_on", F.when(F.col("id") % 9 != 0, "own_page").alias("identity"))
    return quality.without_provenance(rows, "1998-01-01")


@query("SELECT user_id, specialty, CASE WHEN user_id IN (SELECT user_id FROM profiles p JOIN directory d ON p.specialty = lower(d.specialty) WHERE (watermark IS NULL OR created_on > watermark) AND created_on <= " + DAY + ") THEN " + DAY + " ELSE watermark END AS watermark FROM profiles")
def advanced_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = A.profiles(spark, sf_dir)
    told = alerts.specialty_alerts(users, A.conferences(spark, sf_dir).filter("NOT archived"), AS_OF)
    return alerts.advance_watermarks(users, told, AS_OF)


@query(f"""SELECT DISTINCT user_id, conference_id, start_date - 1 - CAST(event_id % 3 AS INT) AS scheduled_for FROM (SELECT event_id, user_id, event_id * 3 % 20000 AS conference_id FROM events WHERE event_type = 'view') JOIN conferences ON id = conference_id
WHERE start_date - 1 - CAST(event_id % 3 AS INT) >= {DAY} AND (user_id, conference_id, start_date - 1 - CAST(event_id % 3 AS INT)) NOT IN (SELECT (user_id, conference_id, scheduled_for) FROM reminders)""")
def new_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    wishes = A.raw(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", (e * 3 % 20000).alias("conference_id"), (e % 3 + 1).cast("int").alias("lead"))
    return alerts.new_reminders(wishes, A.conferences(spark, sf_dir), A.reminders(spark, sf_dir).select("user_id", "conference_id", "scheduled_for"), AS_OF)


@query()
def lane_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.overflow(calendar.lanes(A.conferences(spark, sf_dir).filter("NOT archived")))


@query("""SELECT id FROM directory WHERE (regexp_matches(name || ' ' || specialty, '(?i)\\bbuildings?\\b') AND regexp_matches(name, '(?i)\\bcongress\\b') AND NOT coalesce(city = 'NATION_5', FALSE)) OR name ILIKE 'household workshop %'""")
def fulltext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, a phrase, an alternative and an exclusion, over name, specialty and city of all events."""
    rows = A.conferences(spark, sf_dir).filter("NOT archived")
    held = rows.select("id", search.stems(F.concat_ws(" ", "name", "specialty", "city")).alias("held"))
    return held.filter(search.matches('the buildings congresses -"nation 5" or "household workshop"', F.col("held"))).select("id")
