"""Forecast models on planted series."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from regionwatch.operators import forecast, lag_regression
from regionwatch.plans import forecasting

WEEK = [0.0, 4.0, 2.0, -3.0, 1.0, 5.0, -2.0]


def series(spark, n=400):
    rows = []
    for z, slope in (("10001", 0.05), ("02101", 0.0)):
        for i in range(n):
            rows.append((dt.date(2022, 1, 1) + dt.timedelta(days=i), z, 100 + slope * i + WEEK[i % 7], 20.0 + math.sin(i), 50.0 + i % 3))
    rows += [(dt.date(2022, 1, 1) + dt.timedelta(days=i), "short", 5.0, 1.0, 1.0) for i in range(10)]
    return spark.createDataFrame(rows, "date date, zipcode string, er_visits double, temperature_c double, aqi double")


def test_seasonal_model_recovers_a_noiseless_series(spark):
    df = series(spark)
    train = df.filter(F.col("date") < F.lit("2022-12-25").cast("date"))
    frame = forecast.forecast_frame(train)
    models = forecast.fit(frame).persist()
    assert {r["zipcode"]: r["status"] for r in models.collect()} == {"10001": "ok", "02101": "ok"}
    ahead = forecast.predict(models, forecast.future_frame(frame, 30, history=False))
    both = ahead.join(df.withColumnRenamed("date", "ds"), ["zipcode", "ds"]).collect()
    assert len(both) == 60
    assert max(abs(r["yhat"] - r["er_visits"]) for r in both) < 3.0
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in both)


def test_a_failing_region_does_not_stop_the_others(spark):
    frame = forecast.forecast_frame(series(spark, 60))
    broken = frame.withColumn("y", F.when(F.col("zipcode") == "02101", float("inf")).otherwise(F.col("y")))
    out = {r["zipcode"]: r["status"] for r in forecast.fit(broken).collect()}
    assert out["10001"] == "ok" and len(out) == 2


def test_interval_floors_only_point_and_lower(spark):
    df = spark.createDataFrame([(-5.0, 2.0)], "yhat double, sigma double")
    row = forecast.with_interval(df, 0.9).first()
    assert row["yhat"] == 0.0 and row["yhat_lower"] == 0.0 and row["yhat_upper"] == pytest.approx(-5 + 1.6448536 * 2)


def test_regressor_with_gaps_is_left_out(spark):
    df = series(spark, 40).withColumn("aqi", F.when(F.col("date") != F.lit("2022-01-05").cast("date"), F.col("aqi")))
    assert forecast.forecast_frame(df).filter("aqi is not null").isEmpty()


def test_future_fill_modes(spark):
    frame = forecast.forecast_frame(series(spark, 40))
    last = forecast.future_frame(frame, 3, "last", history=False).filter("zipcode = '10001'").collect()
    zero = forecast.future_frame(frame, 3, "zero", history=False).filter("zipcode = '10001'").collect()
    assert len(last) == 3 and {r["aqi"] for r in last} == {50.0 + 39 % 3} and {r["aqi"] for r in zero} == {0.0}


def test_recursive_forecast_follows_the_weekly_pattern(spark):
    df = series(spark).filter("zipcode <> 'short'")
    model, history = lag_regression.fit(df, features=("er_visits", "temperature_c"))
    assert {r["split"] for r in history.collect()} == {"train", "validation"}
    out = lag_regression.forecast(model, df, 14).filter("zipcode = '02101'").orderBy("ds").collect()
    want = [100 + WEEK[(400 + i) % 7] for i in range(14)]
    assert len(out) == 14 and max(abs(r["yhat"] - w) for r, w in zip(out, want)) < 1.0


def test_forecast_job_reports_every_model(spark):
    df = series(spark).filter("zipcode <> 'short'").withColumns({"pharmacy_sales": F.lit(1.0) + F.rand(1), "negative_sentiment": F.rand(2)})
    cut = F.lit("2022-12-01").cast("date")
    out = forecasting.run(df.filter(F.col("date") < cut), df.filter(F.col("date") >= cut))
    results = out.results.collect()
    assert sorted((r["model"], r["zipcode"]) for r in results) == [("lag_regression", "all"), ("seasonal", "02101"), ("seasonal", "10001")]
    assert out.average.first()["avg_mae"] < 3.0


def test_global_model_query_runs_the_full_regression(spark):
    """Every lag of every signal, through its table, against a recursion by hand."""
    from regionwatch import catalog
    from regionwatch.catalog.base import cleaned
    from regionwatch.operators import clean

    folder = "/root/testdata/sf0.001"
    train = clean.split(cleaned(spark, folder))[0]
    model, _ = lag_regression.fit(train)
    signals = lag_regression.SIGNALS
    rows = {}
    for r in train.na.drop(subset=list(signals)).select("zipcode", "date", *signals).orderBy("zipcode", "date").collect():
        rows.setdefault(r["zipcode"], []).append([float(r[s]) for s in signals])
    want = []
    for window in rows.values():
        if len(window) >= model.lookback:
            for _ in range(lag_regression.P.FORECAST_HORIZON):
                flat = [v for row in window[-model.lookback :] for v in row]
                value = sum(a * b for a, b in zip(flat, model.weights)) + model.intercept
                window.append([value if s == lag_regression.P.TARGET else v for s, v in zip(signals, window[-1])])
                want.append(max(value, 0.0))
    got = [r["yhat"] for r in catalog.all_queries()["s14_global_model"](spark, folder).orderBy("zipcode", "ds").collect()]
    assert model.lookback > 1 and want and got == pytest.approx(want, abs=1e-4)
