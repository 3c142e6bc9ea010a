"""Dates in prose: ranges, weekdays and days without a year, resolved about a reference day. Column expressions only.

A mention is one point, or two with a word or dash between them; a point is a day with or without month and year, in
either order. What a mention says is told by the sorts of its parts in their order, so that all forms share one rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.functions.texts import _date as made
from eventide.functions.texts import safe_date

# Names of months and weekdays, words between the ends of a range, and words before days that are no event's.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sept": 9, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
BETWEEN = r"(?:[-–—]|to|until|till)"
NO_EVENT = r"(?i)(?:posted|published|updated|modified|written|created|deadline|closes?|until|by)\s*(?:on|:)?\s*$"
# End of fixed values.

MONTH = r"(?<![A-Za-z])(?:" + "|".join(MONTHS) + r")(?![A-Za-z])"
WEEKDAY = r"(?<![A-Za-z])(?:" + "|".join(WEEKDAYS) + r")[a-z]*"
DAY = r"\d{1,2}(?:st|nd|rd|th)?(?![\d:]|[A-Za-z])"
YEAR = r"\d{4}(?!\d)"
POINT = rf"(?:{WEEKDAY}\.?,?\s+)?(?:{DAY}\s+(?:of\s+)?{MONTH}\.?(?:,?\s+{YEAR})?|{MONTH}\.?\s+{DAY}(?:,?\s+{YEAR})?|{DAY}(?:,\s*{YEAR})?)"
ISO, FIGURES = rf"(?<!\d){YEAR}-\d\d-\d\d(?![\dT])", rf"(?<![\d/.])\d{{1,2}}([/.])\d{{1,2}}\1{YEAR}"
MENTION = rf"(?i){ISO}|{FIGURES}|(?<![\d:./]){POINT}(?:\s*{BETWEEN}\s*{POINT})?"
PART = rf"(?i){MONTH}|{WEEKDAY}|\d{{4}}|\d{{1,2}}|(?<![A-Za-z]){BETWEEN}"
#: Sorts of parts that make dates: weekdays left out, D day, M month, Y year, - between.
WITH_YEAR = ["DMY", "MDY", "DMY-DMY", "DM-DMY", "D-DMY", "MDY-MDY", "MD-MDY", "MD-DY", "MDY-DY"]
BY_WEEKDAY = ["WDM", "WDM-DM", "WDM-WDM"]


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _month(name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), F.lower(name))


def on(year: Column, month: Column, dom: Column) -> Column:
    """The day as a date; null if it does not exist."""
    return made(F.lpad(year.cast("string"), 4, "0"), month.cast("string"), dom.cast("string"))


def year_of(weekday: Column, month: Column, dom: Column, today: Column) -> Column:
    """The year, last, this or next, in which a day falls on a weekday (0: Monday); of several the nearest to today, the earlier first."""
    days = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: on(F.year(today) + k, month, dom))
    fits = F.filter(days, lambda d: F.weekday(d) == weekday)
    return F.year(F.array_min(F.transform(fits, lambda d: F.struct(F.abs(F.date_diff(d, today)).alias("gap"), d.alias("day"))))["day"])


def mentions(text: Column, today: Column) -> Column:
    """The dates that a text mentions, in its order: array of structs of first, last, said, before (what stands ahead, from the mention before on).

    A single day is first and last. A range over the year's end begins the year before; one that ends before it begins is
    its first day. A weekday with a day and a month but no year is resolved about today. Days after such words as posted
    or deadline, days that do not exist, and times joined by T are left out; figures that are no date do no harm.
    """
    said = F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    between = F.split(F.regexp_replace(text, MENTION, "\x01"), "\x01", -1)

    def read(x: Column) -> Column:
        parts = F.regexp_extract_all(x["said"], F.lit(PART), F.lit(0))
        kind = lambda p: F.when(p.rlike(r"^\d{4}$"), "Y").when(p.rlike(r"^\d"), "D").when(_month(p).isNotNull(), "M").when(p.rlike(rf"(?i)^{WEEKDAY}$"), "W").otherwise("-")
        sorts = F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), p.alias("part")))
        return _once(F.struct(sorts.alias("parts"), x["said"].alias("said"), x["before"].alias("before")), resolve)

    def resolve(x: Column) -> Column:
        of = lambda k: F.transform(F.filter(x["parts"], lambda p: p["kind"] == k), lambda p: p["part"])
        kinds = F.array_join(F.transform(x["parts"], lambda p: p["kind"]), "")
        numbers = F.struct(
            F.transform(of("D"), lambda d: d.cast("int")).alias("days"), F.transform(of("M"), _month).alias("months"), F.transform(of("Y"), lambda y: y.cast("int")).alias("years"),
            F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.lower(F.left(F.get(of("W"), 0), F.lit(3)))).alias("weekday"), kinds.alias("kinds"), F.replace(kinds, F.lit("W"), F.lit("")).alias("plain"), x["said"].alias("said"), x["before"].alias("before"),
        )
        return _once(numbers, ends)

    def ends(n: Column) -> Column:
        day, month, year = (lambda k, i: F.get(n[k], F.lit(0) if i == 0 else F.size(n[k]) - 1) for _ in range(3))
        d1, d2, m1, m2, y2 = day("days", 0), day("days", 1), month("months", 0), month("months", 1), year("years", 1)
        over = F.when(m1 > m2, 1).otherwise(0)
        y1 = F.when(F.size(n["years"]) > 1, F.get(n["years"], 0)).otherwise(y2 - over)
        resolved = year_of((n["weekday"] - 1).cast("int"), m1, d1, today)
        a, b, y = F.get(n["days"], 0), F.get(n["days"], 1), F.get(n["years"], 0)
        figures = F.when(b <= 12, on(y, b, a)).otherwise(on(y, a, b))
        pair = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
        found = (
            F.when(n["said"].rlike(f"^{ISO}$"), _once(safe_date(n["said"]), lambda d: pair(d, d)))
            .when(n["said"].rlike(f"^{FIGURES}$"), _once(figures, lambda d: pair(d, d)))
            .when(n["plain"].isin(*WITH_YEAR), pair(on(y1, m1, d1), on(y2, m2, d2)))
            .when(n["kinds"].isin(*BY_WEEKDAY), _once(resolved, lambda y: _once(on(y, m1, d1), lambda d: pair(d, F.coalesce(on(y + over, m2, d2), d)))))
        )
        return _once(found, lambda f: F.struct(f["first"].alias("first"), F.greatest(f["first"], f["last"]).alias("last"), (f["first"].isNotNull() & f["last"].isNotNull()).alias("whole"), n["said"].alias("said"), n["before"].alias("before")))

    pieces = F.zip_with(said, F.slice(between, 1, F.size(said)), lambda s, b: F.struct(s.alias("said"), b.alias("before")))
    kept = F.filter(F.transform(pieces, read), lambda x: x["whole"])
    kept = F.filter(kept, lambda x: ~F.right(x["before"], F.lit(24)).rlike(NO_EVENT))
    return F.transform(kept, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["said"].alias("said"), x["before"].alias("before")))


def event_days(text: Column, today: Column) -> Column:
    """first and last day that a card or heading gives an event: its first mention, up to a second one if that is labelled as the end; null without any."""

    def pick(all_of: Column) -> Column:
        one, two = F.get(all_of, 0), F.get(all_of, 1)
        until = (one["first"] == one["last"]) & two["before"].rlike(r"(?i)\bend") & (two["first"] >= one["first"])
        return F.when(F.size(all_of) > 0, F.struct(one["first"].alias("first"), F.when(until, two["last"]).otherwise(one["last"]).alias("last")))

    return _once(mentions(text, today), pick)


def coming(month: Column, dom: Column, today: Column, before: Column | None = None) -> Column:
    """A day without a year: the next one from today on; if that is after `before`, the last one up to that."""
    here = on(F.year(today), month, dom)
    following = F.when(here >= today, here).otherwise(on(F.year(today) + 1, month, dom))
    return following if before is None else F.when(following > before, last_up_to(before, month, dom)).otherwise(following)


def last_up_to(ref: Column, month: Column, dom: Column) -> Column:
    """The last occurrence of a day up to a reference day, this year's or last year's."""
    here = on(F.year(ref), month, dom)
    return F.when(here <= ref, here).otherwise(on(F.year(ref) - 1, month, dom))


def span_up_to(line: Column, ref: Column) -> Column:
    """first and last of a line that is a day or a span without a year, such as 3 - 5 May or May 30 - June 2: the last ones up to a reference day; null for other lines."""
    two = rf"(?i)^\s*(?:({MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*{BETWEEN}\s*(?:({MONTH})\.?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?)?|(\d{{1,2}})(?:st|nd|rd|th)?(?:\s+({MONTH}))?(?:\s*{BETWEEN}\s*(\d{{1,2}})(?:st|nd|rd|th)?)?\s+({MONTH}))\.?\s*$"
    short = rf"(?i)^\s*(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH})\.?\s*$"
    g = [F.nullif(F.regexp_extract(line, two, i), F.lit("")) for i in range(1, 9)]
    m1, d1 = _month(F.coalesce(g[0], g[5], g[7])), F.coalesce(g[1], g[4]).cast("int")
    m2, d2 = _month(F.coalesce(g[2], g[0], g[7])), F.coalesce(g[3], g[1], g[6], g[4]).cast("int")
    last = last_up_to(ref, m2, d2)
    first = last_up_to(last, m1, d1)
    single = _once(last_up_to(ref, _month(F.regexp_extract(line, short, 2)), F.regexp_extract(line, short, 1).try_cast("int")), lambda d: F.struct(d.alias("first"), d.alias("last")))
    return F.when(line.rlike(short), single).when(line.rlike(two), F.struct(first.alias("first"), last.alias("last")))
