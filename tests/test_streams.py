"""Streams worked off in several batches: late and repeated rows, restarts."""

import datetime

from eventide.operators import alerts
from eventide.streaming import alerts as stream_alerts
from eventide.streaming import health

AS_OF = "1998-06-01"
EVENTS = "id long, specialty string, created_on date"


def day(n):
    return datetime.date(1998, 4, 1) + datetime.timedelta(n)


def test_alerts_over_batches(spark, tmp_path):
    """Every batch tells what is new in it; late rows are told once, repeated ones not again, and a restart repeats nothing."""
    profiles = spark.createDataFrame([(1, "a", None), (2, "a", day(10)), (3, "b", day(0)), (4, "other", None), (5, None, None), (6, "c", None)], "user_id long, specialty string, watermark date")
    batches = [
        [(1, "A", day(5)), (2, "a", day(20)), (3, "b", day(21))],
        [(4, "a", day(22)), (2, "a", day(20)), (5, "B", day(1))],  # a repeated row, and a late one
        [(6, "a", day(12)), (6, "a", day(12)), (7, "a", day(200)), (8, None, day(3))],  # late; repeated in its batch; after today
    ]
    source, place = tmp_path / "events", str(tmp_path / "place")
    assert stream_alerts.told(profiles, place).isEmpty()
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(source / f"part={k}"))
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(source))
        stream_alerts.tell(stream, profiles, AS_OF, place)
        stream_alerts.tell(stream, profiles, AS_OF, place)  # nothing new: nothing told
        seen += rows
        got = {tuple(r) for r in stream_alerts.totals(stream_alerts.told(profiles, place)).select("user_id", "matched", "newest", "shown").collect()}
        want = {tuple(r) for r in alerts.specialty_alerts(profiles, spark.createDataFrame(sorted(set(seen), key=str), EVENTS), AS_OF).select("user_id", "matched", "newest", "shown").collect()}
        assert got == want
    told = stream_alerts.told(profiles, place)
    assert {r["user_id"]: r["watermark"] for r in stream_alerts.marks(profiles, told).collect()} == {1: day(22), 2: day(22), 3: day(21), 4: None, 5: None, 6: None}


def test_health_goes_on(spark, tmp_path):
    kind = "id long, source_id long, run_started_at timestamp, status string"
    at = datetime.datetime(2024, 1, 1)
    source, place = tmp_path / "runs", str(tmp_path / "place")
    for k, rows in enumerate([[(1, 7, at, "success"), (2, 7, at, "failed")], [(3, 7, at + datetime.timedelta(1), "success"), (4, 8, at, "failed")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(source / f"part={k}"))
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(source))
        got = health.run_available(health.source_health(stream), place)
        assert {tuple(r) for r in got.collect()} == [{(7, 2, 1, 2, "failed")}, {(7, 3, 1, 3, "success"), (8, 1, 1, 4, "failed")}][k]
        assert {tuple(r) for r in health.run_available(health.source_health(stream), place).collect()} == {tuple(r) for r in got.collect()}
