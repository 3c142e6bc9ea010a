"""Records on their way in: merging a listing with its page, validation, cleaning of tiers, summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import money
from eventide.functions.predicates import day
from eventide.functions.texts import safe_date

# Titles that are messages of a page, titles of main events, labels without meaning.
JUNK_TITLE = r"(?i)^(there are no results|no results|no events|no upcoming events|loading|page not found|sorry,?\s*(something|we)|search results|select a|\.\.\.)"
FLAGSHIP = r"(?i)\b(world\s+congress|international\s+(congress|conference)|annual\s+(conference|congress|meeting|symposium)|annual\s+scientific\s+(meeting|conference)|national\s+(conference|congress))\b"
JUNK_LABELS = ("from", "to", "fees", "fee", "sponsor", "cost", "price", "prices", "n/a", "tbc", "tba")
FORMAT_WORDS = {
    "online": r"(?i)\b(online|virtual|webinar|live\s*stream|livestream|zoom|teams|remote|on-demand)\b",
    "in_person": r"(?i)\b(in[- ]person|on[- ]site|onsite|face[- ]to[- ]face)\b",
    "hybrid": r"(?i)\bhybrid\b",
}
# End of fixed values.


def junk_title(title: Column) -> Column:
    """Empty, or a message that a listing shows instead of events."""
    return F.coalesce(F.trim(title) == "", F.lit(True)) | F.trim(title).rlike(JUNK_TITLE)


def format_of(text: Column) -> Column:
    """hybrid if a text says so or both of the others, else the one it says; null if none."""
    online, there = text.rlike(FORMAT_WORDS["online"]), text.rlike(FORMAT_WORDS["in_person"])
    return F.when(text.rlike(FORMAT_WORDS["hybrid"]) | (online & there), "hybrid").when(online, "online").when(there, "in_person")


def merge(listing: DataFrame, page: DataFrame, key: str = "id") -> DataFrame:
    """A listing's rows with what their pages add: the page's name unless it is junk, dates of the listing first, an end that defaults to the start.

    An event that the listing has online is online and has no city. Without a page, the listing speaks alone.
    """
    l, p = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"p.{c}"))
    both = listing.alias("l").join(page.alias("p"), F.col(f"l.{key}") == F.col(f"p.{key}"), "left")
    start = F.coalesce(l("start_date"), p("start_date"))
    online = F.coalesce(l("hint") == "Online", F.lit(False))
    return both.select(
        l(key).alias(key),
        F.when(~junk_title(p("name")), p("name")).otherwise(l("name")).alias("name"),
        start.alias("start_date"),
        F.coalesce(l("end_date"), p("end_date"), start).alias("end_date"),
        F.when(online, "online").otherwise(p("event_format")).alias("event_format"),
        F.when(~online, p("city")).alias("city"),
        F.coalesce(l("is_sold_out"), p("is_sold_out"), F.lit(False)).alias("is_sold_out"),
    )


def validated(records: DataFrame, as_of: str) -> DataFrame:
    """Records as they may be stored, with valid and warnings (joined by a semicolon).

    Without a name or source a record is not valid. Dates that are none become null; points are rounded half up; unknown
    formats become null, unknown types conferences; a call is open only with a deadline to come, or with a note and no deadline.
    """
    dates = ("start_date", "end_date", "abstract_deadline")
    parsed = {d: safe_date(F.col(d)) for d in dates}
    points = F.col("cpd_points").try_cast("double")
    deadline, note = parsed["abstract_deadline"], F.col("abstract_deadline_note")
    claimed = F.coalesce(F.col("abstract_open"), F.lit(False))
    holds = F.when(deadline.isNotNull(), deadline >= day(as_of)).otherwise(F.coalesce(note != "", F.lit(False)))
    form, kind = F.col("event_format"), F.col("event_type")
    warnings = [F.when((F.col(d) != "") & parsed[d].isNull(), F.lit(f"{d} is no date")) for d in dates]
    warnings += [F.when(F.col("cpd_points").isNotNull() & points.isNull(), "cpd_points is no number"), F.when(claimed & ~holds, "call is not open"), F.when(form.isNotNull() & ~form.isin("in_person", "online", "hybrid"), "unknown format"), F.when(kind.isNotNull() & ~kind.isin("conference", "course", "workshop", "degree"), "unknown type")]
    warnings += [F.when(F.coalesce(parsed.get(c, F.col(c)).cast("string"), F.lit("")) == "", f"no {c}") for c in ("start_date", "city")]
    return records.select(
        "id",
        (F.coalesce(F.trim("name") != "", F.lit(False)) & F.col("source_id").isNotNull()).alias("valid"),
        *(parsed[d].alias(d) for d in dates),
        (F.signum(points) * F.floor(F.abs(points) + 0.5)).cast("int").alias("cpd_points"),
        (claimed & holds).alias("abstract_open"),
        F.when(form.isin("in_person", "online", "hybrid"), form).alias("event_format"),
        F.when(kind.isin("conference", "course", "workshop", "degree"), kind).otherwise("conference").alias("event_type"),
        F.array_join(F.array_compact(F.array(*warnings)), ";").alias("warnings"),
    )


def clean_label(label: Column) -> Column:
    """Without white space in rows, punctuation and marks of footnotes at the ends."""
    folded = F.trim(F.regexp_replace(label, "[\\s\u00a0\u202f]+", " "))
    return F.regexp_replace(F.regexp_replace(folded, r"[\s\-–—:·|/*]+$", ""), r"^[\s\-–—:·|/]+", "")


def clean_tiers(tiers: DataFrame) -> DataFrame:
    """conference_id, label, price, currency, id: tiers with a known currency, a plausible price over 0 and a label of three letters or more that means something; of equal ones the first."""
    label = clean_label(F.col("tier_label"))
    rows = tiers.select("id", "conference_id", label.alias("label"), "price", money.currency(F.col("currency")).alias("currency"))
    letters = F.length(F.regexp_replace("label", "[^A-Za-z]", ""))
    good = rows.filter(F.col("currency").isNotNull() & (F.col("price") > 0) & money.plausible(F.col("price"), F.col("currency")) & (letters >= 3) & ~F.lower("label").isin(*JUNK_LABELS))
    return good.groupBy("conference_id", "label", "price", "currency").agg(F.min("id").alias("id"))


def composite_tiers(tiers: DataFrame) -> DataFrame:
    """Of the labels of an event that agree in their first two parts (between dots) and their price, the one of most parts; then the first."""
    parts = F.split("label", " · ")
    rows = tiers.withColumn("parts", F.size(parts)).withColumn("head", F.array_join(F.slice(parts, 1, 2), " · "))
    best = Window.partitionBy("conference_id", "head", "price").orderBy(F.desc("parts"), "id")
    return rows.withColumn("place", F.row_number().over(best)).filter("place = 1").select("conference_id", "id", "label", "price")


def without_echoes(lines: Column) -> Column:
    """Lines without those that equal the one before."""
    return F.filter(lines, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(lines, i - 1)))


def priced_late(conferences: DataFrame, tiers: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """id: live events without tiers whose details are older than some days, or were never read."""
    old = conferences.filter(~F.col("archived") & (F.col("last_detail_on").isNull() | (F.col("last_detail_on") < F.date_sub(day(as_of), days))))
    return old.join(tiers.select(F.col("conference_id").alias("id")).distinct(), "id", "left_anti").select("id")


def missing_sections(events: DataFrame, tiers: DataFrame) -> DataFrame:
    """id, sections: what a visitor may add to an event, in order, joined by commas; a note always."""
    priced = tiers.select(F.col("conference_id").alias("id")).distinct().withColumn("priced", F.lit(True))
    offline = F.coalesce(F.col("event_format") != "online", F.lit(True))
    call = F.col("abstract_deadline").isNull() & F.col("abstract_deadline_note").isNull() & ~F.col("abstract_open")
    sections = F.array(F.when(F.col("start_date").isNull(), "dates"), F.when(offline & F.col("city").isNull(), "venue"), F.when(F.col("priced").isNull(), "fees"), F.when(call, "abstracts"), F.when(~F.col("cpd_accredited"), "cpd"), F.lit("note"))
    return events.join(priced, "id", "left").select("id", F.array_join(F.array_compact(sections), ",").alias("sections"))


def work_order(rows: DataFrame, as_of: str, recent: int = 3, limit: int = 100) -> DataFrame:
    """place, id: what to mend first: never tried, then tried longer ago, then lately; within these, rows without tiers before such with weak ones, then the oldest."""
    bucket = F.when(F.col("tried_on").isNull(), 0).when(F.col("tried_on") < F.date_sub(day(as_of), recent), 1).otherwise(2)
    order = [F.asc("bucket"), F.asc("weak"), F.asc_nulls_first("tried_on"), F.asc("id")]
    first = rows.withColumn("bucket", bucket).orderBy(*order).limit(limit)
    return first.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "id", "bucket")  # of the first rows only


def run_status(found: DataFrame) -> DataFrame:
    """source_id, status: of the counts of a run: blocked or unreachable if nothing else came, failed if nothing was written, partial with errors, else success."""
    n = lambda c: F.sum(F.col(c))
    status = F.when((n("written") == 0) & (n("blocked") > 0), "blocked").when((n("written") == 0) & (n("errors") > 0), "failed").when(n("errors") + n("blocked") > 0, "partial").otherwise("success")
    return found.groupBy("source_id").agg(status.alias("status"), n("written").alias("written"))


def promotions(outcomes: DataFrame, hits: int = 3, misses: int = 3) -> DataFrame:
    """source_id, hits, misses, state: a pattern is promoted at some hits, and dropped at some misses after its last hit."""
    last = outcomes.groupBy("source_id").agg(F.max(F.when(F.col("hit"), F.struct("at", "id"))).alias("last"), F.count_if("hit").alias("hits"))
    after = outcomes.join(last, "source_id").filter(~F.col("hit") & (F.col("last").isNull() | (F.struct("at", "id") > F.col("last")))).groupBy("source_id").agg(F.count(F.lit(1)).alias("misses"))
    both = last.join(after, "source_id", "left").na.fill(0, ["misses"])
    return both.select("source_id", "hits", "misses", F.when(F.col("misses") >= misses, "dropped").when(F.col("hits") >= hits, "promoted").otherwise("learning").alias("state"))
