"""Field audits: what a page says against what is stored. A row for each event and field, with a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions import money
from eventide.functions.texts import all_dates
from eventide.operators.records import FLAGSHIP

OK, SUSPECT, MISSING, ABSENT, NONE = "OK", "SUSPECT", "MISSING", "GENUINELY_ABSENT", "NOT_APPLICABLE"
# Phrases of menus, wordings of calls for papers, and of points and venues.
MENU = r"(?i)(register now|login|menu|cookie policy|javascript is required)"
CALL = r"(?i)(\babstracts?\b|call\s+for\s+(papers|posters|submissions|proposals)|poster\s+(presentations?|sessions?|submissions?))"
POINTS = r"(?i)(?<![\w#.])(\d{1,3}(\.\d)?)\s*CPD\s*(credits?|points?|hours?)"
HELD_AT = r"(will\s+be\s+held\s+at|held\s+at|hosted\s+at|takes?\s+place\s+at)\s+the\s+[A-Z][\w'&,\-. ]{5,80}"
# End of fixed values.


def _first(*rules: tuple[Column, str], other: str = OK) -> Column:
    """The verdict of the first rule that holds; a rule about unknown values does not."""
    out = F.lit(other)
    for holds, verdict in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), verdict).otherwise(out)
    return out


def verdicts(events: DataFrame, pages: DataFrame, tiers: DataFrame) -> DataFrame:
    """id, field, verdict of nine fields of every event that has a page (id, page_text)."""
    zero = tiers.groupBy(F.col("conference_id").alias("id")).agg(F.count(F.lit(1)).alias("tiers"), F.count_if(F.col("price") == 0).alias("zeros"))
    rows = events.join(pages, "id").join(zero, "id", "left")
    page, form, kind = F.coalesce("page_text", F.lit("")), F.col("event_format"), F.col("event_type")
    about, n = F.trim(F.coalesce("description", F.lit(""))), F.length(F.trim(F.coalesce("description", F.lit(""))))
    words = F.filter(F.split(F.lower("name"), "[^a-z]+"), lambda w: (F.length(w) >= 4) & ~w.isin("annual", "meeting", "conference", "congress", "event", "symposium", "summit", "workshop", "course"))
    shares = (F.size(words) == 0) | F.exists(words, lambda w: F.contains(F.lower(about), w))
    dated, ranged = F.size(all_dates(page)) > 0, F.size(all_dates(page)) > 1
    online = form == "online"
    call, known = page.rlike(CALL), F.col("abstract_deadline").isNotNull() | F.col("abstract_deadline_note").isNotNull()
    priced, fees = F.col("tiers") > 0, F.size(money.fees(page)) > 0
    flagship = F.col("name").rlike(FLAGSHIP)
    checks = {
        "description": _first((n == 0, MISSING), (~n.between(50, 700), SUSPECT), (about.rlike(MENU), SUSPECT), (~shares, SUSPECT)),
        "start_date": _first((F.col("start_date").isNotNull(), OK), (dated, MISSING), other=ABSENT),
        "end_date": _first((F.col("end_date").isNotNull(), OK), (ranged, MISSING), other=ABSENT),
        "city": _first((online & F.col("city").isNull(), NONE), (F.col("city").isNull(), MISSING)),
        "venue_name": _first((online, NONE), (page.rlike(HELD_AT), MISSING), other=ABSENT),
        "event_format": _first((form.isNull() | ~form.isin("online", "in_person", "hybrid"), MISSING), (online & F.contains("name", F.coalesce("city", F.lit("\n"))), SUSPECT)),
        "is_flagship": _first((flagship & ~F.col("is_flagship"), MISSING)),
        "cpd_points": _first((F.col("cpd_points") > 0, OK), (page.rlike(POINTS), MISSING), other=ABSENT),
        "abstract_status": _first((~kind.isin("conference", "workshop") & ~F.col("name").rlike(CALL), NONE), (call & ~known, MISSING), (~call & F.col("abstract_open"), SUSPECT)),
        "pricing": _first((priced & (F.col("zeros") == F.col("tiers")) & fees, SUSPECT), (priced, OK), (fees, MISSING), other=ABSENT),
    }
    return rows.select("id", "source_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*checks.values()))).alias("field", "verdict"))


def scores(found: DataFrame) -> DataFrame:
    """id, source_id, score (of what applies the part that is no gap, in per cent), passes (nothing missing or suspect)."""
    applies = F.count_if(F.col("verdict") != NONE)
    good = F.count_if(F.col("verdict").isin(OK, ABSENT))
    return found.groupBy("id", "source_id").agg(F.round(100.0 * good / applies, 1).alias("score"), (F.count_if(F.col("verdict").isin(SUSPECT, MISSING)) == 0).alias("passes"))


def sources(rows: DataFrame) -> DataFrame:
    """source_id, events, passed, average: what scores() says of a source's events."""
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("events"), F.count_if("passes").alias("passed"), F.round(F.avg("score"), 2).alias("average"))


def counted(found: DataFrame) -> DataFrame:
    """source_id with its numbers of verdicts by kind."""
    return found.groupBy("source_id").agg(*(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in (OK, SUSPECT, MISSING, ABSENT)))


def shared_evidence(evidence: DataFrame, most: int = 2) -> DataFrame:
    """id, verdict: what rests on a text that more events show than `most` says nothing about any of them."""
    spread = evidence.groupBy("text").agg(F.count_distinct("id").alias("events")).filter(F.col("events") > most).select("text").withColumn("shared", F.lit(True))
    return evidence.join(spread, "text", "left").select("id", F.when(F.col("shared"), "UNKNOWN").otherwise(F.col("verdict")).alias("verdict"))


def free_verdict(prices: Column, says_free: Column) -> Column:
    """Of an event stored as free: wrong if its page names a price, right if it says free, else unknown."""
    return F.when(prices, "WRONG_FREE").when(says_free, "LEGIT_FREE").otherwise("UNKNOWN")
