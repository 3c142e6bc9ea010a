"""The date grammar on written cases: ranges, weekdays, days without a year, figures before dates."""

import datetime

from pyspark.sql import functions as F

from eventide.functions import dates
from eventide.functions import texts as T
from tests.test_texts import results

day = datetime.date
TODAY = "2026-10-01"


def today():
    return F.lit(TODAY).cast("date")


def test_mentions(spark):
    one = lambda *ymd: [(day(*ymd), day(*ymd))]
    two = lambda a, b: [(day(*a), day(*b))]
    cases = [
        ("28 October, 2026 - 29 October 2026", two((2026, 10, 28), (2026, 10, 29))), ("30 Sep - 2 Oct, 2026", two((2026, 9, 30), (2026, 10, 2))), ("2-4 November, 2026", two((2026, 11, 2), (2026, 11, 4))),
        ("October 17 - 20, 2026", two((2026, 10, 17), (2026, 10, 20))), ("Oct 17 - Nov 2, 2026", two((2026, 10, 17), (2026, 11, 2))), ("December 30, 2026 - January 2, 2027", two((2026, 12, 30), (2027, 1, 2))),
        ("30 Dec to 2 Jan 2027", two((2026, 12, 30), (2027, 1, 2))), ("3rd December 2026", one(2026, 12, 3)), ("September 25, 2026", one(2026, 9, 25)), ("Friday 19 June 2026 | Hall", one(2026, 6, 19)),
        ("12/10/2026", one(2026, 10, 12)), ("10/25/2026", one(2026, 10, 25)), ("12.10.2026", one(2026, 10, 12)), ("2026-10-12", one(2026, 10, 12)), ("2026-10-12T10:00", []),
        ("Wednesday 11 – Thursday 12 November 2026", two((2026, 11, 11), (2026, 11, 12))), ("11 to 12 November 2026", two((2026, 11, 11), (2026, 11, 12))), ("29 June - 2 July 2026", two((2026, 6, 29), (2026, 7, 2))), ("18—19 May 2026", two((2026, 5, 18), (2026, 5, 19))),
        ("Days 1, 2, 3 May 2026", one(2026, 5, 3)), ("Rooms 5 10 12 May 2026", one(2026, 5, 12)), ("Hall 3: 4 May 2026", one(2026, 5, 4)), ("At 10:30, 4 May 2026", one(2026, 5, 4)), ("500 delegates, 4 May 2026", one(2026, 5, 4)), ("the 4th of May 2026", one(2026, 5, 4)),
        ("Tuesday 10 November", one(2026, 11, 10)), ("Tue 17 – Wed 18 November", []), ("Tuesday 17 November – Wednesday 18 November", two((2026, 11, 17), (2026, 11, 18))), ("Thursday 31 December - Saturday 2 January", two((2026, 12, 31), (2027, 1, 2))), ("Monday 10 November", one(2025, 11, 10)),
        ("10 November", []), ("31 June 2026", []), ("Posted on 3 May 2026", []), ("Deadline: 3 May 2026", []), ("Updated 1 May 2026. Held 3 May 2026", one(2026, 5, 3)), ("5 May 2026 - 3 May 2026", one(2026, 5, 5)), ("March 3 2026 and 4 May 2026", [*one(2026, 3, 3), *one(2026, 5, 4)]),
        ("mayor 3 2026", []), ("", []), (None, None),
    ]
    got, want = results(spark, cases, lambda c: F.transform(dates.mentions(c, today()), lambda x: F.struct(x["first"], x["last"])), "array")
    assert [g if g is None else [tuple(x) for x in g] for g in got] == want


def test_event_days(spark):
    cases = [
        ("Start: 12 October 2026 End: 13 October 2026", (day(2026, 10, 12), day(2026, 10, 13))), ("12 October 2026, dinner 13 October 2026", (day(2026, 10, 12), day(2026, 10, 12))), ("12 - 14 October 2026, ends 20 October 2026", (day(2026, 10, 12), day(2026, 10, 14))),
        ("12 October 2026 ends 1 October 2026", (day(2026, 10, 12), day(2026, 10, 12))), ("soon", None), (None, None),
    ]
    got, want = results(spark, cases, lambda c: dates.event_days(c, today()), "struct")
    assert [g and tuple(g) for g in got] == want


def test_days_without_a_year(spark):
    rows = spark.createDataFrame([(3, 5, None, day(2027, 3, 5)), (10, 1, None, day(2026, 10, 1)), (11, 5, day(2026, 12, 1), day(2026, 11, 5)), (3, 5, day(2026, 12, 1), day(2026, 3, 5)), (12, 5, day(2026, 12, 1), day(2025, 12, 5)), (2, 30, None, None)], "m int, d int, before date, want date")
    got = rows.select(F.when(F.col("before").isNull(), dates.coming(F.col("m"), F.col("d"), today())).otherwise(dates.coming(F.col("m"), F.col("d"), today(), F.col("before"))).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got
    cases = [
        ("May 30 - June 2", (day(2026, 5, 30), day(2026, 6, 2))), ("30 December - 2 January", (day(2025, 12, 30), day(2026, 1, 2))), ("3 - 5 May", (day(2026, 5, 3), day(2026, 5, 5))), ("5 November", (day(2025, 11, 5), day(2025, 11, 5))), ("October 1", (day(2026, 10, 1), day(2026, 10, 1))),
        ("May 3 to 5", (day(2026, 5, 3), day(2026, 5, 5))), ("Held on 3 May", None), ("31 June", None), ("", None), (None, None),
    ]
    got, want = results(spark, cases, lambda c: dates.span_up_to(c, today()), "struct")
    assert [g and (tuple(g) if g[0] else None) for g in got] == want


def test_figures_before_a_date(spark):
    cases = [("Days 1, 2, 3 May 2026", day(2026, 5, 3)), ("Rooms 5 10 12 May 2026", day(2026, 5, 12)), ("Hall 12/3, 1/5/2026", day(2026, 5, 1)), ("Septe 3, 2026", None), ("Sept. 3, 2026", day(2026, 9, 3))]
    got, want = results(spark, cases, T.date_phrase)
    assert got == want
