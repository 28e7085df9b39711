"""Sparse trend changes, modes and intervals of the seasonal model against plain computations."""

from __future__ import annotations

import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest

from regionwatch import catalog, params as P
from regionwatch.catalog.base import cleaned
from regionwatch.catalog.forecast_queries import frame
from regionwatch.operators import clean, forecast
from regionwatch.plans import forecasting

FOLDER = "/root/testdata/sf0.001"
START = dt.date(2022, 1, 1)


def frame_of(spark, values):
    """{zipcode: y per day} as a forecast frame."""
    rows = [(z, START + dt.timedelta(days=i), float(v)) for z, ys in values.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "zipcode string, ds date, y double")


def plain_design(start, end, days, values, means, stds):
    """The design of one region by a plain loop; ``values`` are its regressors by day."""
    out = []
    for k, day in enumerate(days):
        t = (day - start).days / (end - start).days
        d = (day - dt.date(1970, 1, 1)).days
        row = [1.0, t, *(max(t - P.CHANGE_POINT_RANGE * j / P.CHANGE_POINTS, 0.0) for j in range(1, P.CHANGE_POINTS + 1))]
        for period, order in ((365.25, P.YEARLY_ORDER), (7.0, P.WEEKLY_ORDER)):
            for i in range(1, order + 1):
                row += [np.sin(2 * np.pi * i * d / period), np.cos(2 * np.pi * i * d / period)]
        for v, m, s in zip(values[k], means, stds):
            row.append((v - m) / s if v is not None and s else 0.0)
        out.append(row)
    return np.array(out)


def by_region(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["zipcode"], []).append(r)
    return {z: sorted(rows, key=lambda r: r["ds"]) for z, rows in out.items()}


def moments(rows):
    """Mean and deviation of each regressor of one region, None where it has none."""
    columns = [[r[c] for r in rows] for c in P.REGRESSORS]
    return [np.mean(c) if c[0] is not None else None for c in columns], [np.std(c) if c[0] is not None else None for c in columns]


def test_descent_reaches_the_minimum(spark):
    rng = np.random.default_rng(3)
    x = np.maximum(np.linspace(0, 1, 300)[:, None] - np.linspace(0, 0.8, 25)[None, :], 0)
    gram, right, weight = x.T @ x, x.T @ rng.normal(size=300).cumsum(), 2.0
    got = forecast.soft_descent(gram, right, weight)
    pull = right - gram @ got
    assert (got == 0).any() and (got != 0).any()
    assert np.abs(pull[got == 0]).max() <= weight * (1 + 1e-6)
    assert pull[got != 0] == pytest.approx(weight * np.sign(got[got != 0]), rel=1e-5)
    assert forecast.soft_descent(gram, right, 1e9).tolist() == [0.0] * 25


def test_coefficients_of_the_query_are_the_most_probable(spark):
    """No coefficient of any region can move without making the fit less probable."""
    data = by_region(frame(spark, FOLDER))
    found = {}
    for r in catalog.all_queries()["f05_region_coefficients"](spark, FOLDER).collect():
        found.setdefault(r["zipcode"], {})[r["term"]] = r
    assert found and set(found) <= set(data)
    for z, terms in found.items():
        rows, beta = data[z], np.array([terms[k]["coefficient"] for k in range(len(terms))])
        days = [r["ds"] for r in rows]
        x = plain_design(days[0], days[-1], days, [[r[c] for c in P.REGRESSORS] for r in rows], *moments(rows))
        scale = max(abs(r["y"]) for r in rows)
        y, n = np.array([r["y"] for r in rows]) / scale, forecast.TREND_TERMS
        level, factor = x[:, :n] @ beta[:n], 1 + x[:, n:] @ beta[n:]
        left = y - level * factor
        noise = np.sqrt(np.mean(left**2))
        assert noise * scale == pytest.approx(terms[0]["sigma"], rel=1e-4)
        pull = np.concatenate([(x[:, :n] * factor[:, None]).T @ left, (x[:, n:] * level[:, None]).T @ left])
        size = noise**2 * len(y) ** 0.5
        assert abs(pull[0]) < 0.01 * size and abs(pull[1] - noise**2 / 25 * beta[1]) < 0.01 * size
        assert np.abs(pull[n:] - noise**2 / 100 * beta[n:]).max() < 0.01 * size
        changes, most = beta[2:n], noise**2 / 0.05
        assert np.abs(pull[2:n]).max() <= most * 1.01
        assert pull[2:n][changes != 0] == pytest.approx(most * np.sign(changes[changes != 0]), rel=0.01)


def test_forecast_rows_follow_from_the_coefficients(spark):
    train = forecast.forecast_frame(clean.split(cleaned(spark, FOLDER))[0])
    data = by_region(train)
    models = {r["zipcode"]: r for r in forecast.fit(train).collect()}
    got = by_region(catalog.all_queries()["f06_seasonal_rows"](spark, FOLDER))
    z90, n = NormalDist().inv_cdf(0.95), forecast.TREND_TERMS
    assert got and set(got) == set(models)
    for z, out in got.items():
        rows, m = data[z], models[z]
        start, end, scale = rows[0]["ds"], rows[-1]["ds"], max(abs(r["y"]) for r in rows)
        last = [rows[-1][c] for c in P.REGRESSORS]
        days = [end + dt.timedelta(days=i + 1) for i in range(P.FORECAST_HORIZON)]
        assert [r["ds"] for r in out] == days
        x, beta = plain_design(start, end, days, [last] * len(days), *moments(rows)), np.array(m["beta"])
        factor = 1 + x[:, n:] @ beta[n:]
        mean = x[:, :n] @ beta[:n] * factor * scale
        drift = 2 * P.CHANGE_POINTS * np.abs(beta[2:n]).mean() ** 2 * (x[:, 1] - 1) ** 3 / 3
        spread = z90 * np.sqrt(m["sigma"] ** 2 + (factor * scale) ** 2 * drift)
        assert [r["yhat"] for r in out] == pytest.approx(np.maximum(mean, 0).tolist(), abs=1e-6)
        assert [r["yhat_lower"] for r in out] == pytest.approx(np.maximum(mean - spread, 0).tolist(), abs=1e-6)
        assert [r["yhat_upper"] for r in out] == pytest.approx((mean + spread).tolist(), abs=1e-6)


def test_planted_changes_are_found_and_few(spark):
    rng = np.random.default_rng(5)
    day = np.arange(700)
    bend = 100 + 0.3 * day - 0.6 * np.maximum(day - 280, 0)  # half of the range of change points
    values = {"bend": bend + rng.normal(0, 1, 700), "line": 50 + 0.1 * day + rng.normal(0, 1, 700)}
    options = forecast.SeasonalOptions(mode=forecast.ADDITIVE, yearly=False)
    models = forecast.fit(frame_of(spark, values), options=options).persist()
    found = {}
    for r in forecast.changes(models).collect():
        found.setdefault(r["zipcode"], []).append((r["ds"], r["slope_change"]))
    near = [c for d, c in found["bend"] if abs((d - START).days - 280) <= 45]
    assert sum(near) == pytest.approx(-0.6, abs=0.08)
    assert sum(abs(c) for d, c in found["bend"] if abs((d - START).days - 280) > 45) < 0.1
    assert len(found["bend"]) < 12 and sum(abs(c) for _, c in found.get("line", [])) < 0.05


def test_intervals_cover_as_often_as_they_say(spark):
    """Each region goes on with changes as frequent and large as in its past."""
    rng = np.random.default_rng(11)
    n, ahead, values, truth = 400, 60, {}, {}
    for k in range(60):
        slope = np.full(n + ahead, 0.2)
        for at in range(40, n + ahead, 80):
            slope[at:] += rng.laplace(0, 0.15)
        y = 500 + slope.cumsum() + rng.normal(0, 2, n + ahead)
        values[f"z{k:02d}"], truth[f"z{k:02d}"] = y[:n], y[n:]
    rows = frame_of(spark, values)
    models = forecast.fit(rows, options=forecast.SeasonalOptions(mode=forecast.ADDITIVE, yearly=False)).persist()
    out = by_region(forecast.predict(models, forecast.future_frame(rows, ahead, history=False), 0.9))
    inside = [r["yhat_lower"] <= y <= r["yhat_upper"] for z, rs in out.items() for r, y in zip(rs, truth[z])]
    widths = [rs[-1]["yhat_upper"] - rs[-1]["yhat_lower"] - rs[0]["yhat_upper"] + rs[0]["yhat_lower"] for rs in out.values()]
    assert len(inside) == 60 * ahead and 0.8 <= np.mean(inside) <= 0.99
    assert min(widths) >= 0 and np.mean(widths) > 0


def test_modes_and_switches(spark):
    day = np.arange(420)
    week = np.array([0, 4, 2, -3, 1, 5, -2])[day % 7]
    grown = 100 + 0.5 * day
    rows = frame_of(spark, {"added": grown + 2.0 * week, "times": grown * (1 + 0.02 * week)})
    fits = {m: {r["zipcode"]: r for r in forecast.fit(rows, options=forecast.SeasonalOptions(mode=m)).collect()} for m in (forecast.ADDITIVE, forecast.MULTIPLICATIVE)}
    assert fits["additive"]["added"]["sigma"] < 0.2 * fits["multiplicative"]["added"]["sigma"]
    assert fits["multiplicative"]["times"]["sigma"] < 0.2 * fits["additive"]["times"]["sigma"]
    flat = forecast.fit(rows, options=forecast.SeasonalOptions(yearly=False, weekly=False, change_scale=0)).collect()
    assert all(not any(r["beta"][2:]) and r["change_size"] == 0.0 for r in flat)
    with pytest.raises(ValueError):
        forecast.SeasonalOptions(mode="none")


def test_job_takes_regions_target_and_metrics(spark):
    train, _, test = clean.split(cleaned(spark, FOLDER))
    out = forecasting.run(
        train, test, horizon=5, with_lag_regression=False, regions=["10001", "10002"], target="aqi", regressors=("temperature_c",), chosen_metrics=("mae",), width=0.5
    )
    assert {r["zipcode"] for r in out.forecast.select("zipcode").distinct().collect()} <= {"10001", "10002"}
    assert out.results.columns == ["model", "zipcode", "n_samples", "mae"] and out.average.columns == ["avg_mae"]
