"""Column expressions of the directory: dates, prices, places, titles."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which events count as British, which titles are degrees and which words say nothing.
UK_REGION = r"(?i)(england|scotland|wales|northern ireland|^uk$)"
UK_CITY = r"(?i)^(london|glasgow|edinburgh|liverpool|manchester|birmingham|cardiff|sheffield|belfast|leeds|bristol)$"
DEGREE = (
    r"(?i)(\b(m\.?sc|b\.?sc|mres|mphil|phd|dphil|mba|mph|pgcert|pgdip)\b|\bpostgraduate\s+(certificate|diploma)\b|\bdiploma\s+in\b|\badvanced\s+certificate\s+in\b"
    r"|\bcertificate\s+in\b.*\blevel\s*7\b|\bmaster'?s?\s+(of|in)\b|\bbachelors?\s+of\b|\bdoctorate\s+(in|of)\b)"
)
NOT_DEGREE = (
    r"(?i)(\b(ceremon\w*|graduation|awards?|prepar\w*|revision|exam\w*|mock|osce|symposium|congress|conference|webinar|lecture|open\s+day|viva|workshop|open\s+evening"
    r"|info(rmation)?\s+(session|evening)|alumni|interview|live\s+20\d\d|networking|taster|masterclass)\b|\bfor\s+the\s+diploma\b"
    r"|,\s*(md|do|mph|mba|phd|msc|mres|mphil|dphil|pgcert|pgdip|facs|frcp|frcs|frca|mrcp|mrcs|rn|bds)\b)"
)
STOP_WORDS = (
    "the and for with of in on at to a an annual conference congress meeting symposium course workshop international national "
    "society association college royal update summit forum event virtual online"
).split()


def day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def preset_days(preset: str, as_of: str) -> tuple[str, str] | None:
    """First and last day of this-month, next-3-months or this-year, from today on; None for other names."""
    today = datetime.date.fromisoformat(as_of)
    months = {"this-month": today.month, "next-3-months": today.month + 2, "this-year": 12}.get(preset)
    if months is None:
        return None
    after = datetime.date(today.year + months // 12, months % 12 + 1, 1)
    return as_of, str(after - datetime.timedelta(1))


def country_guess() -> Column:
    region, city = F.col("region"), F.col("city")
    return F.when(F.col("event_format") == "online", "unknown").when(region.rlike(UK_REGION) | city.rlike(UK_CITY), "uk").when(region.isNull() & city.isNull(), "unknown").otherwise("international")


def price_bucket(price: str = "price_from") -> Column:
    """Disjoint buckets; an unknown price is never free."""
    p = F.col(price)
    return F.when(p.isNull(), "unknown").when(p == 0, "free").when(p < 100, "under-100").when(p < 300, "under-300").otherwise("over-300")


def price_matches(choice: str) -> Column:
    """The cumulative price filter; unknown prices match ``any`` only."""
    p = F.col("price_from")
    return {"any": F.lit(True), "free": p == 0, "under-100": p < 100, "under-300": p < 300}[choice]


def overlaps(first: str | None, last: str | None) -> Column:
    """Events that touch the days from first to last; undated ones fail when either is given."""
    start, end = F.col("start_date"), F.coalesce("end_date", "start_date")
    out = F.lit(True)
    if last:
        out = out & (start <= day(last))
    if first:
        out = out & (end >= day(first))
    return out & (start.isNotNull() if first or last else F.lit(True))


def date_group(as_of: str) -> Column:
    """0 for upcoming or undated, 1 for ongoing, null for finished events."""
    start, end, now = F.col("start_date"), F.col("end_date"), day(as_of)
    return F.when(start.isNull() | (start >= now), 0).when(end >= now, 1)


def abstracts_open(as_of: str) -> Column:
    """Open, and either not past the deadline or without one but with a note."""
    d = F.col("abstract_deadline")
    return F.col("abstract_open") & F.when(d.isNotNull(), d >= day(as_of)).otherwise(F.col("abstract_deadline_note").isNotNull())


def degree_title(title: str) -> Column:
    t = F.coalesce(F.col(title), F.lit(""))
    return t.rlike(DEGREE) & ~t.rlike(NOT_DEGREE)


def significant_words(name: str) -> Column:
    """Distinct lower-case words of three characters or more, without stop words and numbers."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(F.col(name), F.lit(""))), "[^a-z0-9\\s]", " "), "\\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~w.isin(STOP_WORDS)))


def page_base(url: str) -> Column:
    """A URL without its fragment."""
    return F.regexp_replace(url, "#.*$", "")


def listing_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, nulls empty, joined by a bar."""
    return F.sha2(F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), "|"), 256)


def excerpt(text: str, length: int = 300) -> Column:
    """White space folded and trimmed, cut to a length; null if nothing is left."""
    said = F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(length))
    return F.when(said != "", said)
