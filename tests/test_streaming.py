"""Streams over several files equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionwatch.functions import windows
from regionwatch.session import work_folder
from regionwatch.streaming import alerts, daily_panel

FOLDER = "/root/testdata/sf0.001"


def events_in_files(spark):
    """The events as three files, the latest days first."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    folder = work_folder(spark, "events")
    cuts = ["2024-02-01", "2024-01-20", "2024-01-10", "2024-01-01"]
    for b, a in zip(cuts, cuts[1:]):
        part = events.filter((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(folder)
    keys = [F.to_date("ts").alias("date"), (F.lit(10000) + F.col("user_id") % 15).cast("string").alias("zipcode")]
    return events, folder, keys


def same(got, want):
    got = got.select(*want.columns)
    return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_incremental_panel_loses_no_late_row(spark):
    events, folder, keys = events_in_files(spark)
    want = events.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
    )
    got = daily_panel.incremental_panel(spark, folder, "*.parquet", 1)
    assert got.agg(F.sum("n_events")).first()[0] == events.count()
    assert same(got.withColumn("total", F.col("total").cast("decimal(38,2)")), want)


def test_late_copies_are_dropped_and_late_keys_kept(spark):
    events, folder, keys = events_in_files(spark)
    assert same(daily_panel.deduplicated(spark, folder, "*.parquet", 1), events.select(*keys, "event_type").distinct())


def test_alerts_do_not_depend_on_the_order_of_days(spark):
    daily = spark.range(120).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("date"),
        F.when(F.col("id") < 60, "02101").otherwise("10001").alias("zipcode"),
        (F.col("id") * 37 % 101 + F.when(F.col("id") == 50, 900).otherwise(0)).cast("double").alias("value"),
    )
    out = work_folder(spark, "alerts")
    for a in (45, 15, 30, 0):
        day = F.datediff("date", F.lit("2024-01-01").cast("date"))
        daily.filter((day >= a) & (day < a + 15)).coalesce(1).write.mode("append").parquet(f"{out}/days")
    got = {(r["zipcode"], r["date"]): (round(r["zscore"], 6), r["alert"]) for r in alerts.score_stream(spark, f"{out}/days", out, 1).collect()}
    z = daily.withColumn("z", windows.rolling_zscore("value")).withColumn("alert", windows.flag(F.col("z")))
    assert got == {(r["zipcode"], r["date"]): (round(r["z"], 6), r["alert"]) for r in z.collect()}


def test_stateful_alerts_equal_the_window(spark):
    daily = spark.range(120).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("date"),
        F.when(F.col("id") < 60, "02101").otherwise("10001").alias("zipcode"),
        (F.col("id") * 37 % 101 + F.when(F.col("id") == 50, 900).otherwise(0)).cast("double").alias("value"),
    )
    got = {(r["zipcode"], r["date"]): (round(r["zscore"], 6), r["alert"]) for r in alerts.run_alerts(spark, daily, 4).collect()}
    z = daily.withColumn("z", windows.rolling_zscore("value")).withColumn("alert", windows.flag(F.col("z")))
    want = {(r["zipcode"], r["date"]): (round(r["z"], 6), r["alert"]) for r in z.collect()}
    assert got == want and sum(a for _, a in got.values()) >= 1
