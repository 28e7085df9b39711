"""Rolling z-score alerts over a stream of daily rows, whatever order the days come in.

A micro-batch lands its rows and scores again what they touch: a region's days from its first new one on, beside the
window's worth of rows before. Both go to folders of the batch's number, so a repeated batch overwrites itself;
readers keep the latest score of each day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import params as P
from ..functions import windows
from ..session import work_folder

DAILY = "zipcode string, date date, value double"


def rescored(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Scores of every day that the batch's rows can change; ``known`` holds them and all earlier rows."""
    touched = batch.groupBy("zipcode").agg(F.min("date").alias("_first"))
    rows = known.join(touched, "zipcode")
    before = rows.where("date < _first").withColumn("_back", F.row_number().over(W.partitionBy("zipcode").orderBy(F.col("date").desc())))
    near = before.where(F.col("_back") < P.ANOMALY_WINDOW).drop("_back").unionByName(rows.where("date >= _first"))
    scored = near.withColumn("zscore", windows.rolling_zscore("value"))
    scored = scored.withColumn("alert", windows.flag(F.col("zscore")))
    return scored.where("date >= _first").select("zipcode", "date", "value", "zscore", "alert")


def latest(rows: DataFrame, *values: str) -> DataFrame:
    """The row of the highest batch number for each region and day."""
    kept = rows.groupBy("zipcode", "date").agg(F.max_by(F.struct(*values), "number").alias("v"))
    return kept.select("zipcode", "date", "v.*")


def run_alerts(spark: SparkSession, daily: DataFrame, parts: int = 2) -> DataFrame:
    """Land the daily rows in ``parts`` stretches of days and score them as a stream."""
    out = work_folder(spark, "alerts")
    rows = daily.select("zipcode", "date", F.col("value").cast("double").alias("value"))
    span = rows.agg(F.struct(F.min("date").alias("a"), F.max("date").alias("b")).alias("s")).scalar()
    share = F.floor(F.datediff("date", F.col("_s.a")) * parts / (F.datediff(F.col("_s.b"), F.col("_s.a")) + 1))
    placed = rows.withColumn("_s", span).withColumn("part", share.cast("int")).drop("_s")
    placed.write.partitionBy("part").parquet(f"{out}/landed")
    return score_stream(spark, f"{out}/landed", out, files_per_batch=1)


def score_stream(spark: SparkSession, landed: str, out: str, files_per_batch: int = 1_000) -> DataFrame:
    """Scores all files under ``landed`` that have not been scored; returns the scored rows so far."""
    stream = spark.readStream.schema(DAILY).option("maxFilesPerTrigger", files_per_batch).parquet(landed)

    def score(batch: DataFrame, number: int) -> None:
        batch.select("zipcode", "date", "value").write.mode("overwrite").parquet(f"{out}/known/number={number}")
        known = spark.read.parquet(f"{out}/known").where(F.col("number") <= number)
        new = known.where(F.col("number") == number)
        rescored(latest(known, "value"), new).write.mode("overwrite").parquet(f"{out}/scored/number={number}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).foreachBatch(score).start()
    )
    query.awaitTermination()
    return latest(spark.read.parquet(f"{out}/scored"), "value", "zscore", "alert")
