"""Window features, scores and metrics against pandas and known values."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regionwatch import params as P
from regionwatch.functions import scores, windows
from regionwatch.functions.calendar import calendar_columns
from regionwatch.operators import features, metrics, region, scaling, sequences

SIGNALS = ["pharmacy_sales", "negative_sentiment", "er_visits", "aqi", "temperature_c", "humidity_pct"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    frames = []
    for zipcode, n in (("10001", 80), ("02101", 40), ("60601", 1)):
        f = pd.DataFrame({c: rng.normal(50, 10, n) for c in SIGNALS})
        f["date"] = pd.date_range("2023-01-01", periods=n)
        f["zipcode"] = zipcode
        frames.append(f)
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def panel(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("date", F.to_date("date")).persist()


@pytest.fixture(scope="module")
def built(panel):
    return features.feature_panel(panel).toPandas().sort_values(["zipcode", "date"]).reset_index(drop=True)


def expected(pdf, fn):
    ordered = pdf.sort_values(["zipcode", "date"]).reset_index(drop=True)
    return ordered.groupby("zipcode")["aqi"].transform(fn).to_numpy()


def test_lag_and_rolling_match_pandas(pdf, built):
    assert np.allclose(built["aqi_lag_7"].astype(float), expected(pdf, lambda x: x.shift(7)), equal_nan=True)
    assert np.allclose(built["aqi_roll_14_mean"], expected(pdf, lambda x: x.rolling(14, min_periods=1).mean()))
    assert np.allclose(built["aqi_roll_30_std"], expected(pdf, lambda x: x.rolling(30, min_periods=2).std().fillna(0)))
    assert np.allclose(built["aqi_roll_3_max"], expected(pdf, lambda x: x.rolling(3, min_periods=1).max()))
    assert np.allclose(built["aqi_pct_change_1"], np.clip(expected(pdf, lambda x: x.pct_change().fillna(0)), -5, 5))
    z = expected(pdf, lambda x: ((x - x.rolling(30, min_periods=5).mean()) / (x.rolling(30, min_periods=5).std() + 1e-8)).fillna(0))
    assert np.allclose(built["aqi_zscore"], z)


def test_feature_job_keeps_rows_and_is_finite(pdf, built):
    assert len(built) == len(pdf)
    assert len(built.columns) == len(pdf.columns) + 12 + 20 + 60 + 8 + 8 + 3 + 1
    assert built["disease_risk_score"].between(0, 1).all()
    assert not np.isinf(built.select_dtypes("number").to_numpy(dtype=float)).any()


def test_all_windows_share_one_node(panel):
    plan = features.windowed_features(panel)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("InMemoryRelation")[0]
    assert top.count("Window [") == 1 and top.count("Exchange") == 1 and top.count("Sort [") == 1


def test_pct_change_zero_denominators_and_padding(spark):
    values = [0.0, 3.0, 0.0, 0.0, -2.0, 0.0, None, 4.0]
    rows = [(dt.date(2023, 1, i + 1), "1", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "date date, zipcode string, aqi double")
    out = features.with_pct_changes(df, ["aqi"], [1]).orderBy("date").collect()
    assert [r["aqi_pct_change_1"] for r in out] == [0.0, 5.0, -1.0, 0.0, -5.0, -1.0, 0.0, 5.0]
    assert [r["aqi"] for r in out] == values


def test_constant_region_scores_zero(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1) + dt.timedelta(days=i), "1", 0.1) for i in range(40)], "date date, zipcode string, aqi double")
    out = df.select(windows.rolling_zscore("aqi").alias("z")).distinct().collect()
    assert [r["z"] for r in out] == [0.0]


def test_calendar_ranges(panel):
    out = panel.select(*[c.alias(n) for n, c in calendar_columns().items()]).toPandas()
    assert out["month"].between(1, 12).all() and out["season"].between(1, 4).all()
    assert out[["dow_sin", "dow_cos", "month_sin", "month_cos"]].abs().to_numpy().max() <= 1 + 1e-12


def test_densify_adds_missing_days(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), "1", 1.0), (dt.date(2023, 1, 4), "1", 4.0)], "date date, zipcode string, aqi double")
    assert [r["aqi"] for r in windows.densify(df).orderBy("date").collect()] == [1.0, None, None, 4.0]


def test_levels_colors_and_aqi_modes(spark):
    df = spark.createDataFrame([(0.32, 50.3), (0.33, 50.0), (0.66, 700.0)], "s double, a double")
    s = F.col("s")
    out = df.select(scores.risk_level(s), scores.risk_level_exclusive(s), scores.risk_color(scores.risk_level(s)),
                    scores.aqi_category(F.col("a")), scores.aqi_category(F.col("a"), "reference")).collect()
    assert [tuple(r) for r in out] == [
        ("Low", "Low", "#2ecc71", "Moderate", "Hazardous"),
        ("Medium", "Low", "#f39c12", "Good", "Good"),
        ("High", "Medium", "#e74c3c", "Hazardous", "Hazardous"),
    ]


def test_score_without_components_is_zero(spark):
    assert scores.with_risk_score(spark.range(1)).first()["disease_risk_score"] == 0.0


def test_seasonal_residual_of_short_region_is_zero(panel):
    out = windows.seasonal_residuals(panel, ["aqi"]).filter("zipcode = '60601'").collect()
    assert [r["aqi_stl_resid"] for r in out] == [0.0]


def test_seasonal_residual_of_pure_weekly_pattern_is_small(spark):
    rows = [(dt.date(2023, 1, 1) + dt.timedelta(days=i), "1", float([1, 5, 2, 8, 3, 9, 4][i % 7])) for i in range(70)]
    df = spark.createDataFrame(rows, "date date, zipcode string, aqi double")
    out = windows.seasonal_residuals(df, ["aqi"]).orderBy("date").toPandas()["aqi_stl_resid"]
    assert out[7:-7].abs().max() < 0.5


def test_metrics_on_known_values(spark):
    df = spark.createDataFrame([("a", 10.0, 12.0), ("a", 20.0, 18.0), ("a", 30.0, 33.0), ("b", 1.0, 2.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0)], "zipcode string, y double, yhat double")
    out = {r["zipcode"]: r for r in metrics.evaluate(df, ["zipcode"]).collect()}
    assert out["a"]["mae"] == round(7 / 3, 4) and out["b"]["rmse"] == 1.0 and out["c"]["mape"] == 100.0
    assert "r2" not in metrics.evaluate(df, ["zipcode"], metrics=["mae", "r2"]).columns


@pytest.mark.parametrize("method", ["standard", "minmax"])
def test_scaler_round_trip(panel, method):
    params = scaling.fit(panel, ["aqi"], method)
    scaled = scaling.transform(panel, params, ["aqi"])
    low, high, mean = scaled.agg(F.min("aqi"), F.max("aqi"), F.avg("aqi")).first()
    assert (abs(mean) < 1e-9) if method == "standard" else (low == 0.0 and high == pytest.approx(1.0))
    back = scaling.inverse(scaled, params, ["aqi"]).agg(F.sum("aqi")).first()[0]
    assert back == pytest.approx(panel.agg(F.sum("aqi")).first()[0])


def test_unknown_scaler_is_an_error(panel):
    with pytest.raises(ValueError):
        scaling.fit(panel, ["aqi"], "robust")


def test_sequences_have_no_leakage(spark):
    rows = [(dt.date(2023, 1, 1) + dt.timedelta(days=i), "1", float(i)) for i in range(12)] + [(dt.date(2023, 1, 1), "2", 1.0)]
    df = spark.createDataFrame(rows, "date date, zipcode string, er_visits double")
    out = sequences.lookback_sequences(df, ["er_visits"], lookback=5).orderBy("date").collect()
    assert len(out) == 7
    assert [v[0] for v in out[0]["x"]] == [0.0, 1.0, 2.0, 3.0, 4.0] and out[0]["y"] == 5.0


def test_snapshot_window_is_inclusive(panel):
    assert region.last_days(panel, 30).select("date").distinct().count() == 31
    out = region.snapshot(panel)
    assert out.count() == 3 and out.filter("zipcode is null").isEmpty()


def test_window_fill_orders(spark):
    values = [None, 2.0, None, 3.0, None]
    df = spark.createDataFrame([(dt.date(2023, 1, i + 1), "1", v) for i, v in enumerate(values)], "date date, zipcode string, aqi double")
    assert [r["aqi"] for r in windows.fill_within_region(df, ["aqi"]).orderBy("date").collect()] == [2.0, 2.0, 2.0, 3.0, 3.0]


def test_parameter_tables_are_complete():
    assert len(P.REGIONS) == 15 and len(P.STATIC_LOOKUP) == 25
    assert abs(sum(P.SCORE_WEIGHTS.values()) - 1.0) < 1e-12
