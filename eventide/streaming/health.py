"""Runs of the crawler as a stream: what each source did last."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.sources.shared import folder


def source_health(runs: DataFrame) -> DataFrame:
    """source_id, runs, failed, last_id, last_status. State is one row for each source, however long the stream."""
    last = F.max(F.struct("run_started_at", "id", "status")).alias("last")
    return runs.groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), last).select("source_id", "runs", "failed", F.col("last.id").alias("last_id"), F.col("last.status").alias("last_status"))


def run_available(stream: DataFrame, place: str | None = None) -> DataFrame:
    """All that a stream has now, in batches, each written with its number; the rows of the last one. Empty without input.

    place keeps state and results: called again with the same one the stream goes on from there. Without one it has a
    place of its own in the shared folder.
    """
    spark = stream.sparkSession
    place = place or f"{folder(spark)}/eventide-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    done = spark.createDataFrame([], stream.schema)
    try:
        rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{place}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return done
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch")
