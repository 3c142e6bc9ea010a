"""Calendar views: month grid, agenda, deadlines by day, lanes of a week."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.predicates import day


def spans(events: DataFrame) -> DataFrame:
    """Dated events with first and last day; an end before the start counts as the start."""
    return events.filter("start_date IS NOT NULL").select("id", "name", F.col("start_date").alias("first"), F.greatest("start_date", F.coalesce("end_date", "start_date")).alias("last"))


def month_matrix(spark: SparkSession, year: int, month: int) -> DataFrame:
    """The 42 days of a month's grid, Monday first."""
    head = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    monday = F.date_sub(head, F.weekday(head))
    return spark.range(42).select((F.col("id") / 7).cast("int").alias("week"), (F.col("id") % 7).cast("int").alias("column"), F.date_add(monday, F.col("id").cast("int")).alias("day")).withColumns({"in_month": (F.month("day") == month) & (F.year("day") == year), "weekend": F.col("column") >= 5})


def on_days(events: DataFrame, days: DataFrame) -> DataFrame:
    """days with events: how many are on, on each of the days (a bounded list, such as a month's grid). Events are cut to the days asked for before they are spread over them."""
    first, last = days.agg(F.min("day"), F.max("day")).first()
    own = spans(events).filter((F.col("first") <= last) & (F.col("last") >= first))
    each = own.select(F.explode(F.sequence(F.greatest("first", F.lit(first)), F.least("last", F.lit(last)))).alias("day"))
    return days.join(each.groupBy("day").agg(F.count(F.lit(1)).alias("events")), "day", "left").withColumn("events", F.coalesce("events", F.lit(0)))


def agenda(events: DataFrame, as_of: str) -> DataFrame:
    """month, events, first_id: what is on or to come, by the month it starts in."""
    rows = spans(events).filter(F.col("last") >= day(as_of))
    return rows.groupBy(F.date_format("first", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("events"), F.min_by("id", F.struct("first", "id")).alias("first_id"))


def deadlines(events: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    now = day(as_of)
    return events.filter(F.col("abstract_deadline").between(now, F.date_add(now, days))).groupBy("abstract_deadline").agg(F.count(F.lit(1)).alias("events"), F.min("id").alias("first_id"))


def upcoming(events: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """id, abstract_deadline: deadlines within some days, in order."""
    return events.filter(F.col("abstract_deadline").between(day(as_of), F.date_add(day(as_of), days))).select("id", "abstract_deadline").orderBy("abstract_deadline", "id")


def in_month(events: DataFrame, year: int, month: int) -> DataFrame:
    """id, first, last: events on any day of a month."""
    head = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return spans(events).filter((F.col("first") <= F.last_day(head)) & (F.col("last") >= head)).select("id", "first", "last")


def overflow(placed: DataFrame) -> DataFrame:
    """week, shown, hidden: of lanes() how many pieces of each week found a lane, and how many did not."""
    return placed.groupBy("week").agg(F.count("lane").alias("shown"), F.count_if(F.col("lane").isNull()).alias("hidden"))


def week_pieces(events: DataFrame) -> DataFrame:
    """A row for each week that an event touches, clipped to it: week (its Monday), from and to columns, length of the event."""
    s = spans(events)
    monday = lambda c: F.date_sub(F.col(c), F.weekday(c))
    rows = s.withColumn("week", F.explode(F.sequence(monday("first"), monday("last"), F.expr("INTERVAL 7 DAY"))))
    return rows.select("id", "week", "first", F.greatest(F.datediff("first", "week"), F.lit(0)).alias("from_col"), F.least(F.datediff("last", "week"), F.lit(6)).alias("to_col"), F.datediff("last", "first").alias("length"))


def lanes(events: DataFrame, most: int = 3) -> DataFrame:
    """id, week, lane: each piece in the lowest lane that is free, by start, longer ones first, then id; lane null beyond `most`.

    Weeks are independent: each is swept in order, and only the lanes' last columns are remembered.
    """
    pieces = week_pieces(events).repartition("week").sortWithinPartitions("week", "first", F.desc("length"), "id")

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        week, ends = None, [-1] * most
        for frame in frames:
            out = []
            for w, a, b in zip(frame["week"], frame["from_col"], frame["to_col"], strict=True):
                if w != week:
                    week, ends = w, [-1] * most
                lane = next((k for k, e in enumerate(ends) if e < a), None)
                if lane is not None:
                    ends[lane] = b
                out.append(lane)
            yield frame[["id", "week", "from_col", "to_col"]].assign(lane=pd.array(out, dtype="Int32"))

    return pieces.mapInPandas(sweep, "id long, week date, from_col int, to_col int, lane int")
