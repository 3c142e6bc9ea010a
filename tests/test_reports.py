"""Reports by day: the latest before a day, pruned folders, the newest of nested items."""

import datetime

from pyspark.sql import functions as F

from eventide.sources import reports

KIND = "source_id long, events long"


def test_latest_before(spark, tmp_path):
    place = str(tmp_path / "coverage")
    assert reports.before(spark, place, KIND, "2026-05-03").collect() == []
    for k, day in enumerate(["2026-05-01", "2026-05-02", "2026-05-04"]):
        reports.write(spark.createDataFrame([(1, k), (2, 10 * k)], KIND), place, day)
    reports.write(spark.createDataFrame([(1, 7)], KIND), place, "2026-05-02")  # written again
    at = lambda day: {(r["source_id"], r["events"], str(r["day"])) for r in reports.before(spark, place, KIND, day).collect()}
    assert at("2026-05-01") == set() and at("2026-05-02") == {(1, 0, "2026-05-01"), (2, 0, "2026-05-01")} and at("2026-05-04") == at("2026-05-03") == {(1, 7, "2026-05-02")}
    assert at("2027-01-01") == {(1, 2, "2026-05-04"), (2, 20, "2026-05-04")}
    found = reports.before(spark, place, KIND, "2026-05-04")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and found.inputFiles() and len({f for f in found.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) <= 1


def test_newest(spark):
    day = datetime.date
    rows = [(day(2026, 5, 1), [(1, "a"), (2, "b")]), (day(2026, 5, 3), [(1, "c")]), (day(2026, 5, 2), [(1, "d"), (3, "e"), (3, "f")]), (day(2026, 5, 4), []), (day(2026, 5, 5), None)]
    df = spark.createDataFrame(rows, "day date, items array<struct<id:long,said:string>>")
    assert {(r["id"], r["item"]["said"], r["day"].day) for r in reports.newest(df).collect()} == {(1, "c", 3), (2, "b", 1), (3, "f", 2)}
