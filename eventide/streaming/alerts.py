"""Alerts of new events as a stream: each event is told once, however late or often it comes.

An event's time is when it was created. Repeats of an id within the delay are dropped by state that the watermark clears.
What a batch tells is written under the batch's number, so a batch that runs again after a restart replaces its own rows.
No clock takes part: a row that comes after a user was told of later ones is told in its own batch.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import alerts
from eventide.sources.shared import folder

TOLD = "batch int, user_id long, matched long, newest date"


def fresh(events: DataFrame, delay: str = "60 days") -> DataFrame:
    """A stream's events (id, specialty, created_on, ...), each id once within the delay of event time."""
    timed = events.withColumn("created_at", F.col("created_on").cast("timestamp"))
    return timed.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"]).select("id", "specialty", "created_on")


def tell(events: DataFrame, profiles: DataFrame, as_of: str, place: str, delay: str = "60 days") -> None:
    """Work off what a stream of events has now. place keeps the stream's state and what was told; called again with the same place it goes on."""

    def write(batch: DataFrame, number: int) -> None:
        new = alerts.specialty_alerts(profiles, batch, as_of)
        new.select("user_id", "matched", "newest").write.mode("overwrite").parquet(f"{place}/told/batch={number}")

    fresh(events, delay).writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def told(profiles: DataFrame, place: str) -> DataFrame:
    """batch, user_id, matched, newest: what every batch so far told each user. Empty before the first."""
    spark = profiles.sparkSession
    try:
        return spark.read.schema(TOLD).option("basePath", f"{place}/told").parquet(f"{place}/told")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TOLD)


def totals(told: DataFrame, cap: int = 50) -> DataFrame:
    """user_id, matched, newest, shown: all that a user was told, as ``alerts.specialty_alerts`` gives for a table."""
    return told.groupBy("user_id").agg(F.sum("matched").alias("matched"), F.max("newest").alias("newest")).withColumn("shown", F.least("matched", F.lit(cap)))


def marks(profiles: DataFrame, told: DataFrame) -> DataFrame:
    """Profiles with the watermark at the newest event that a user was told of."""
    newest = told.groupBy("user_id").agg(F.max("newest").alias("newest"))
    return profiles.join(newest, "user_id", "left").withColumn("watermark", F.greatest("watermark", "newest")).drop("newest")


def new_place(profiles: DataFrame, name: str) -> str:
    """A place of its own in the shared folder."""
    return f"{folder(profiles.sparkSession)}/eventide-{name}-{uuid.uuid4().hex}"
