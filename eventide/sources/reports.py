"""Reports by day: a folder for each day, of which only those asked for are read."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.sources.shared import folder


def new_place(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    return f"{folder(spark)}/eventide-{name}-{uuid.uuid4().hex}"


def write(report: DataFrame, place: str, day: str) -> None:
    """The report of a day; written again, it replaces the one before."""
    report.write.mode("overwrite").parquet(f"{place}/day={day}")


def read(spark: SparkSession, place: str, schema: str, days: Column | None = None) -> DataFrame:
    """The reports with their day; days, a condition on it, keeps all other folders unread. Empty where there are none."""
    try:
        rows = spark.read.schema(f"{schema}, day date").parquet(place)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, day date")
    return rows if days is None else rows.filter(days)


def before(spark: SparkSession, place: str, schema: str, day: str) -> DataFrame:
    """The latest report of a day strictly before the one given, with its day; empty without any. Later folders, and all earlier ones but one, are not read."""
    earlier = F.col("day") < F.lit(day).cast("date")
    last = read(spark, place, schema, earlier).select("day").distinct().agg(F.max("day")).first()[0]
    return read(spark, place, schema, F.col("day") == F.lit(last).cast("date") if last else F.lit(False))


def newest(reports: DataFrame, items: str = "items", key: str = "id") -> DataFrame:
    """key, item, day: of each key the item of the newest report that has it, whatever reports hold; reports have a day and an array of structs. Of several in one report the largest counts."""
    each = reports.select("day", F.explode(items).alias("item")).select(F.col(f"item.{key}").alias(key), "item", "day")
    return each.groupBy(key).agg(F.max(F.struct("day", "item")).alias("best")).select(key, "best.item", "best.day")
