"""Text functions on written cases; nulls and empty texts among them."""

import datetime

from pyspark.sql import functions as F

from eventide.functions import texts as T
from eventide.streaming import health


def results(spark, cases, f, kind="string"):
    rows = spark.createDataFrame([(i, said) for i, (said, _) in enumerate(cases)], "i int, said string")
    return [r.out for r in rows.select("i", f(F.col("said")).alias("out")).orderBy("i").collect()], [want for _, want in cases]


def test_numbers(spark):
    cases = [("1,234.50", 1234.5), ("1.234,5", 1234.5), ("1.500.000", 1500000.0), ("1'250", 1250.0), ("1 250,75", 1250.75), ("12,5", 12.5), ("7.500", 7500.0), ("1.2345", None), ("12.", None), ("", None), (None, None), ("ten", None)]
    got, want = results(spark, cases, T.parse_number)
    assert got == want


def test_dates(spark):
    day = datetime.date
    cases = [
        ("Friday 29th May 2026 at noon", day(2026, 5, 29)), ("Sept 3, 2026", day(2026, 9, 3)), ("by 01/12/2026", day(2026, 12, 1)), ("2026-02-28 10:00", day(2026, 2, 28)), ("2026-02-28T10:00", None),
        ("31 June 2026", None), ("2026-02-30", None), ("may follow", None), ("", None), (None, None),
    ]
    got, want = results(spark, cases, T.date_phrase)
    assert got == want
    got, want = results(spark, [("2027-02-31", None), ("2028-02-29", day(2028, 2, 29)), ("2028-2-9", None), ("x", None), ("", None), (None, None)], T.safe_date)
    assert got == want


def test_urls(spark):
    cases = [
        ("HTTPS://Me:x@Example.ORG/a/?utm_source=1&b=2#c", "https://example.org/a?b=2"), ("http://example.org", "http://example.org/"), ("http://example.org/?gclid=1", "http://example.org/"),
        ("ftp://example.org/a", None), ("http:///a", None), ("", None), (None, None),
    ]
    got, want = results(spark, cases, T.normal_url)
    assert got == want
    got, want = results(spark, [("https://a.example.org/x?y", True), ("https://localhost/", False), ("https://127.0.0.1/", False), ("https://u@example.org/", False), ("https://example.org/a b", False), ("", True), (None, True)], T.url_ok)
    assert got == want


def test_points(spark):
    got, want = results(spark, [("worth 6 CPD credits", 6), ("999 CPD points, accredited for 12 points", 12), ("12+ CPD", 12), ("0 CPD points", None), ("", None), (None, None)], T.cpd_points)
    assert got == want


def test_folding(spark):
    for n in (0, 75, 76, 149, 150, 400):
        line = "".join(chr(97 + i % 26) for i in range(n))
        pieces = spark.range(1).select(T.folded(F.lit(line)).alias("out")).head().out.split("\r\n ")
        assert "".join(pieces) == line and len(pieces[0]) <= 75 and all(len(p) <= 74 for p in pieces[1:])
    assert spark.range(1).select(T.calendar_text(F.lit("a\\b\n,;")).alias("out")).head().out == "a\\\\b\\n\\,\\;"


def test_stream_in_batches(spark, tmp_path):
    """More than one batch keeps the state; a stream without rows gives none."""
    schema = "id long, source_id long, run_started_at timestamp, status string"
    at = datetime.datetime(2024, 1, 1)
    for k, status in enumerate(("failed", "success")):
        spark.createDataFrame([(k, 1, at + datetime.timedelta(days=k), status), (10 + k, 2 + k, at, "failed")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = {r.source_id: (r.runs, r.failed, r.last_id, r.last_status) for r in health.run_available(health.source_health(stream)).collect()}
    assert rows == {1: (2, 1, 1, "success"), 2: (1, 1, 10, "failed"), 3: (1, 1, 11, "failed")}
    (tmp_path / "none").mkdir()
    assert health.run_available(health.source_health(spark.readStream.schema(schema).parquet(str(tmp_path / "none")))).isEmpty()
