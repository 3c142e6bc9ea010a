"""Contributions under review: checks of what is sent in, actions on it, and what becomes public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.predicates import day
from eventide.functions.texts import safe_date, url_ok

# What fields of a contribution may be published, the tabs of the queue, the actions and what they lead to.
FIELDS = ("city", "venue_name", "event_format", "cpd_points", "price")
TABS = {"pending": ("pending",), "needs_info": ("needs_info",), "published": ("published", "merged"), "rejected": ("rejected",), "hidden": ("hidden",), "expired": ("expired",)}
OUTCOMES = {"approve": "published", "merge": "merged", "needs_info": "needs_info", "reject": "rejected", "hide": "hidden"}
# End of fixed values.


def payload_errors(payloads: DataFrame) -> DataFrame:
    """id, errors: what is wrong with a payload, in a fixed order, joined by a semicolon; rows without errors have an empty text."""
    amount = F.col("from_price")
    start, end = safe_date(F.col("start_date")), safe_date(F.col("end_date"))
    rules = [
        (~url_ok(F.col("booking_url")), "url"),
        (F.length("name") > 200, "name"),
        (F.length("city") > 120, "city"),
        ((F.col("cpd_points") != "") & ~(F.col("cpd_points").rlike(r"^\d{1,3}$") & (F.col("cpd_points").try_cast("int") <= 500)), "points"),
        ((F.col("event_format") != "") & ~F.col("event_format").isin("in_person", "online", "hybrid"), "format"),
        ((amount != "") & ~(amount.rlike(r"^\d{1,6}(\.\d{1,4})?$") & (amount.try_cast("double") <= 100000)), "price"),
        ((F.col("start_date") != "") & start.isNull(), "start_date"),
        ((F.col("end_date") != "") & end.isNull(), "end_date"),
        (end < start, "order"),
    ]
    return payloads.select("id", F.array_join(F.array_compact(F.array(*(F.when(wrong, name) for wrong, name in rules))), ";").alias("errors"))


def admitted(contributions: DataFrame, most: int = 10) -> DataFrame:
    """Contributions as they enter the queue, all pending: of each user the first ones up to a number."""
    order = Window.partitionBy("user_id").orderBy("created_on", "id")
    return contributions.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("id", "user_id", F.lit("pending").alias("status"))


def moderated(contributions: DataFrame, actions: DataFrame) -> DataFrame:
    """id, status, done, why: contributions after the actions asked for, one each.

    Only open ones are acted on, but what is public may be hidden. What the safety check refused is never approved or
    merged; what it has not seen needs the confirmation that it is unchecked. Publishing needs an event to go to.
    """
    both = contributions.join(actions.select("id", "action", "confirmed"), "id")
    status, action, check = F.col("status"), F.col("action"), F.col("check_status")
    publish = action.isin("approve", "merge")
    why = (
        F.when(~action.isin(*OUTCOMES), "unknown action")
        .when((action == "hide") & ~status.isin("published", "merged"), "not public")
        .when((action != "hide") & ~status.isin("pending", "needs_info"), "closed")
        .when(publish & (check == "skipped"), "unsafe link")
        .when(publish & (check == "waiting") & ~F.coalesce("confirmed", F.lit(False)), "unchecked link")
        .when((action == "merge") & F.col("conference_id").isNull(), "no event")
    )
    outcome = F.lit(None).cast("string")
    for name, to in OUTCOMES.items():
        outcome = F.when(action == name, to).otherwise(outcome)
    return both.select("id", F.when(why.isNull(), outcome).otherwise(status).alias("status"), why.isNull().alias("done"), why.alias("why"))


def facts_of(contributions: DataFrame) -> DataFrame:
    """conference_id, field, value: a row for each field of a published contribution that may be public and says something; of several, the newest contribution's."""
    long = contributions.select("id", "conference_id", F.explode(F.map_filter("fields", lambda k, v: k.isin(*FIELDS) & (F.coalesce(v, F.lit("")) != ""))).alias("field", "value"))
    return long.groupBy("conference_id", "field").agg(F.max_by("value", "id").alias("value"))


def tiers_of(fees: DataFrame) -> DataFrame:
    """conference_id, label, price, currency: priced tiers of a contribution, or one standard tier of its lowest price if it has none."""
    priced = fees.select("conference_id", "currency", F.explode("tiers").alias("t")).filter("t.price IS NOT NULL").select("conference_id", F.coalesce(F.when(F.trim("t.label") != "", F.trim("t.label")), F.lit("Standard")).alias("label"), F.col("t.price").alias("price"), F.coalesce("currency", F.lit("GBP")).alias("currency"))
    rest = fees.filter(F.col("from_price").isNotNull() & ~F.exists("tiers", lambda t: t["price"].isNotNull()))
    return priced.union(rest.select("conference_id", F.lit("Standard"), "from_price", F.coalesce("currency", F.lit("GBP"))))


def agrees(given: Column, found: Column) -> Column:
    """Does what was found confirm what was given, without regard to case and white space? Null where nothing was given."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(F.coalesce(F.trim(given) != "", F.lit(False)), F.coalesce(plain(given) == plain(found), F.lit(False)))


def prices_agree(given: Column, found: Column) -> Column:
    """Are all prices that were given among those found? Null where none was given."""
    return F.when(F.size(given) > 0, F.size(F.array_except(given, found)) == 0)


def review(given: DataFrame, found: DataFrame) -> DataFrame:
    """id, field, final, from_site, disagrees: every field that either side knows; what was given counts, else what was found."""
    both = given.select("id", "field", F.col("value").alias("given")).join(found.select("id", "field", F.col("value").alias("found")), ["id", "field"], "full_outer")
    return both.select("id", "field", F.coalesce("given", "found").alias("final"), F.col("given").isNull().alias("from_site"), F.coalesce(~agrees(F.col("given"), F.col("found")) & F.col("found").isNotNull(), F.lit(False)).alias("disagrees"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1)), r"^www\.", "")


def link_signals(contributions: DataFrame, events: DataFrame) -> DataFrame:
    """id, mismatch (organiser and booking on different hosts), unseen (no event is on the organiser's host)."""
    rows = contributions.select("id", host(F.col("organiser_url")).alias("host"), host(F.col("booking_url")).alias("other"))
    seen = events.select(host(F.col("source_url")).alias("host")).distinct().withColumn("seen", F.lit(True))
    return rows.join(seen, "host", "left").select("id", ((F.col("host") != "") & (F.col("other") != "") & (F.col("host") != F.col("other"))).alias("mismatch"), F.when(F.col("host") != "", F.col("seen").isNull()).alias("unseen"))


def tabs(contributions: DataFrame) -> DataFrame:
    """tab, n: how many contributions each tab of the queue shows."""
    tab = F.lit(None).cast("string")
    for name, statuses in TABS.items():
        tab = F.when(F.col("status").isin(*statuses), name).otherwise(tab)
    return contributions.groupBy(tab.alias("tab")).agg(F.count(F.lit(1)).alias("n")).filter("tab IS NOT NULL")


def breakdown(contributions: DataFrame) -> DataFrame:
    """kind with its numbers by status."""
    return contributions.groupBy("kind").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "published", "rejected")), F.count(F.lit(1)).alias("n"))


def digest(contributions: DataFrame, admins: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """admin_id, waiting, oldest: one notice for each moderator who has none unread of the same content, if anything waits; contributions older than some days count as expired."""
    waiting = contributions.filter((F.col("status") == "pending") & (F.col("created_on") >= F.date_sub(day(as_of), days)))
    now = waiting.agg(F.count(F.lit(1)).alias("waiting"), F.min("created_on").alias("oldest")).filter("waiting > 0")
    both = admins.crossJoin(now)  # one row beside each
    return both.filter(~F.col("unread").eqNullSafe(F.col("waiting"))).select("admin_id", "waiting", "oldest")
