"""Incremental daily panel from an event stream, and streaming de-duplication.

Both keep what each micro-batch adds in a form that can be merged in any order: partial sums by key, or the distinct
keys. A batch writes to a folder of its number, so a repeated batch overwrites itself; readers merge. No row is ever
too late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_folder
from ..sources.derived import TABLES, region_key


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", files_per_batch: int = 1_000) -> DataFrame:
    """Events as a stream, with their day and region."""
    return (
        spark.readStream.schema(TABLES["events"])
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
        .withColumns({"date": F.to_date("ts"), "zipcode": region_key("user_id")})
    )


def daily_partials(events: DataFrame) -> DataFrame:
    """Per region and day: event count, value sum and error count of these events."""
    return events.groupBy("date", "zipcode").agg(
        F.count("*").alias("n_events"),
        F.sum(F.col("value").cast("decimal(18,2)")).alias("total"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
    )


def merged_partials(partials: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n_events", "total", "n_errors")]
    return partials.groupBy("date", "zipcode").agg(*sums)


def first_of_day(events: DataFrame) -> DataFrame:
    """One row per (day, region, event type)."""
    return events.select("date", "zipcode", "event_type").distinct()


def run_batches(stream: DataFrame, out: str, reduced: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Processes all available input; returns the reduced rows of all batches so far."""

    def keep(batch: DataFrame, number: int) -> None:
        reduced(batch).write.mode("overwrite").parquet(f"{out}/parts/number={number}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/parts").drop("number")


def incremental_panel(spark: SparkSession, folder: str, files: str = "events.parquet", files_per_batch: int = 1_000) -> DataFrame:
    """Daily panel built by the stream over all files present."""
    stream = event_stream(spark, folder, files, files_per_batch)
    return merged_partials(run_batches(stream, work_folder(spark, "daily-panel"), daily_partials))


def deduplicated(spark: SparkSession, folder: str, files: str = "events.parquet", files_per_batch: int = 1_000) -> DataFrame:
    stream = event_stream(spark, folder, files, files_per_batch)
    return run_batches(stream, work_folder(spark, "first-of-day"), first_of_day).distinct()
