"""Forecast frames, models and their evaluation."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from .. import params as P
from ..operators import clean, forecast, lag_regression, metrics, region
from ..plans import forecasting
from ..sources import derived
from .base import BLOCKS, BY_DATE, cleaned, merged, query
from .feature_queries import naive_pairs, panel

REG = list(P.REGRESSORS)


def frame(spark, folder):
    return forecast.forecast_frame(cleaned(spark, folder))


def partial_panel(spark, folder):
    # temperature and aqi lose values in some regions, so their use differs by region
    df = cleaned(spark, folder)
    return df.withColumns(
        {
            "aqi": F.when(~((F.col("zipcode") == "10003") & (F.month("date") == 2)), F.col("aqi")),
            "temperature_c": F.when(F.col("zipcode") > "10005", F.col("temperature_c")),
        }
    )


BLOCKS["partial"] = (("clean",), """
    SELECT * REPLACE (CASE WHEN NOT (zipcode = '10003' AND month(date) = 2) THEN aqi END AS aqi, CASE WHEN zipcode > '10005' THEN temperature_c END AS temperature_c) FROM clean""")
USED = ", ".join(f"CASE WHEN count({c}) OVER (PARTITION BY zipcode) = count(*) OVER (PARTITION BY zipcode) THEN {c} END AS {c}" for c in REG)


@query("f01_forecast_frame", f"SELECT zipcode, date AS ds, er_visits AS y, {USED} FROM partial", needs=["partial"], doubles=["y", *REG])
def f01(spark, folder):
    return forecast.forecast_frame(partial_panel(spark, folder))


@query("f02_eligible_regions", """
    SELECT zipcode, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS date, CAST(10000 + user_id % 15 AS VARCHAR) AS zipcode FROM events WHERE event_type = 'signup' GROUP BY 1, 2) AS e
    GROUP BY zipcode HAVING count(*) >= 30""")
def f02(spark, folder):
    daily = derived.event_sources(derived.read(spark, folder, "events"))["er_visits"]
    return forecast.eligible(forecast.forecast_frame(daily)).groupBy("zipcode").agg(F.count("*").alias("n"))


BLOCKS["ends"] = (("clean",), "SELECT zipcode, max(date) AS last, " + ", ".join(f"arg_max({c}, date) AS {c}" for c in REG) + " FROM clean GROUP BY zipcode")


@query("f03_future_frame", f"""
    SELECT zipcode, date AS ds, {', '.join(REG)} FROM clean
    UNION ALL SELECT zipcode, CAST(last + CAST(k AS INTEGER) AS DATE), {', '.join(REG)} FROM ends, range(1, 31) AS r(k)""", needs=["ends"], doubles=REG)
def f03(spark, folder):
    return forecast.future_frame(frame(spark, folder), 30)


@query("f03_future_frame_zero", f"SELECT zipcode, CAST(last + CAST(k AS INTEGER) AS DATE) AS ds, {', '.join(f'0.0::DOUBLE AS {c}' for c in REG)} FROM ends, range(1, 31) AS r(k)", needs=["ends"])
def f03_zero(spark, folder):
    return forecast.future_frame(frame(spark, folder), 30, "zero", history=False)


BLOCKS["scales"] = (("clean",), "SELECT zipcode, min(date) AS a, max(date) AS b, " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in REG) + " FROM clean GROUP BY zipcode")
HINGES = " + ".join(f"greatest(t - {P.CHANGE_POINT_RANGE * j / P.CHANGE_POINTS!r}::DOUBLE, 0)" for j in range(1, P.CHANGE_POINTS + 1))
YEARLY = " + ".join(f"sin({k} * 2 * pi() / 365.25 * d) + cos({k} * 2 * pi() / 365.25 * d)" for k in range(1, P.YEARLY_ORDER + 1))
WEEKLY = " + ".join(f"sin({k} * 2 * pi() / 7 * d) + cos({k} * 2 * pi() / 7 * d)" for k in range(1, P.WEEKLY_ORDER + 1))


@query("f04_design_matrix", f"""
    SELECT zipcode, ds, 57 AS terms, t AS trend, {HINGES} AS hinges, {YEARLY} AS yearly, {WEEKLY} AS weekly, {' + '.join('z_' + c for c in REG)} AS regressors
    FROM (SELECT zipcode, date AS ds, (date - a)::DOUBLE / (b - a) AS t, (date - DATE '1970-01-01')::DOUBLE AS d, {', '.join(f'({c} - m_{c}) / s_{c} AS z_{c}' for c in REG)}
          FROM clean JOIN scales USING (zipcode)) AS x""", needs=["scales"], doubles=["trend", "hinges", "yearly", "weekly", "regressors"])
def f04(spark, folder):
    rows = frame(spark, folder)
    x = forecast.design(rows, forecast.frame_scale(rows))
    part = lambda a, n: F.aggregate(F.slice("x", a, n), F.lit(0.0), lambda s, v: s + v)
    return x.select(
        "zipcode", "ds", F.size("x").alias("terms"), F.col("x")[1].alias("trend"), part(3, 25).alias("hinges"),
        part(28, 20).alias("yearly"), part(48, 6).alias("weekly"), part(54, 4).alias("regressors"),
    )


# trend, two terms for each order of the seasons, and the regressors
MODEL_TERMS = forecast.TREND_TERMS + 2 * (P.YEARLY_ORDER + P.WEEKLY_ORDER) + len(P.REGRESSORS)
MODELS_SQL = f"""SELECT zipcode, count(er_visits) AS n_rows, 'ok' AS status, {MODEL_TERMS} AS terms FROM clean GROUP BY zipcode"""


@query("f05_region_models", MODELS_SQL, needs=["clean"])
def f05(spark, folder):
    models = forecast.fit(frame(spark, folder))
    return models.select("zipcode", "n_rows", "status", F.size("beta").alias("terms"))


@query("f05_region_coefficients")
def f05_coefficients(spark, folder):
    """Every coefficient of every region's model; held against a plain fit in the tests."""
    models = forecast.fit(frame(spark, folder))
    return models.select("zipcode", "mode", "sigma", "change_size", F.posexplode("beta").alias("term", "coefficient"))


@query("f05_trend_changes")
def f05_changes(spark, folder):
    return forecast.changes(forecast.fit(frame(spark, folder)))


DAY = "(date - DATE '1970-01-01')::DOUBLE"
BLOCKS["trained"] = (("labelled",), "SELECT * FROM labelled WHERE split = 'train'")
BLOCKS["lines"] = (("trained",), f"""
    SELECT zipcode, count(*) AS n_rows, regr_slope(er_visits, {DAY}) AS slope, regr_intercept(er_visits, {DAY}) AS intercept,
           sqrt(greatest((regr_syy(er_visits, {DAY}) - regr_slope(er_visits, {DAY}) * regr_sxy(er_visits, {DAY})) / count(*), 0)) AS sigma FROM trained GROUP BY zipcode""")


def split_panel(spark, folder):
    return clean.split(panel(spark, folder, "er_visits"))


def lines(spark, folder):
    train = split_panel(spark, folder)[0]
    return forecast.linear_trend(forecast.forecast_frame(train))


@query("f05_linear_trend", "SELECT zipcode, n_rows, slope * 1000 AS slope, intercept, sigma FROM lines", needs=["lines"], doubles=["slope", "intercept", "sigma"], digits=5)
def f05_line(spark, folder):
    return lines(spark, folder).withColumn("slope", F.col("slope") * 1000)


Z90 = NormalDist().inv_cdf(0.95)
BLOCKS["line_forecast"] = (("labelled", "lines"), f"""
    SELECT zipcode, ds, greatest(p, 0) AS yhat, greatest(p - {Z90!r}::DOUBLE * sigma, 0) AS yhat_lower, p + {Z90!r}::DOUBLE * sigma AS yhat_upper, y FROM (
        SELECT zipcode, date AS ds, intercept + slope * {DAY} AS p, sigma, er_visits AS y FROM labelled JOIN lines USING (zipcode) WHERE split = 'test') AS q""")


def line_forecast(spark, folder):
    test = split_panel(spark, folder)[2]
    return forecast.predict_line(lines(spark, folder), forecast.forecast_frame(test))


@query("f06_interval", "SELECT zipcode, ds, yhat, yhat_lower, yhat_upper FROM line_forecast", needs=["line_forecast"], doubles=["yhat", "yhat_lower", "yhat_upper"], digits=5)
def f06(spark, folder):
    return line_forecast(spark, folder)


# A straight trend and a weekly rhythm added to it, without priors, are least squares on one line and a level for each
# weekday: the slope is that of deviations from the weekday's means.
BLOCKS["weekdays"] = (("trained",), f"SELECT zipcode, dayofweek(date) AS weekday, avg({DAY}) AS day, avg(er_visits) AS y FROM trained GROUP BY 1, 2")
BLOCKS["weekly_line"] = (("trained", "weekdays"), """
    SELECT *, sqrt(greatest(yy - slope * dy, 0) / n_rows) AS sigma FROM (SELECT zipcode, count(*) AS n_rows, sum(d * y) / sum(d * d) AS slope, sum(d * y) AS dy, sum(y * y) AS yy FROM (
        SELECT t.zipcode, (t.date - DATE '1970-01-01')::DOUBLE - w.day AS d, er_visits - w.y AS y FROM trained AS t JOIN weekdays AS w ON w.zipcode = t.zipcode AND w.weekday = dayofweek(t.date)) AS c
    GROUP BY zipcode) AS s""")
WEEKLY_LINE = forecast.SeasonalOptions(mode=forecast.ADDITIVE, yearly=False, slope_scale=None, change_scale=0, season_scale=None)


def weekly_line(spark, folder):
    rows = forecast.forecast_frame(split_panel(spark, folder)[0], regressors=())
    return rows, forecast.fit(rows, options=WEEKLY_LINE)


@query("f05_additive_weekly", "SELECT zipcode, n_rows, slope * 1000 AS slope, sigma FROM weekly_line", needs=["weekly_line"], doubles=["slope", "sigma"], digits=5)
def f05_weekly(spark, folder):
    per_day = F.col("beta")[1] * F.col("y_scale") / F.datediff("end", "start")
    return weekly_line(spark, folder)[1].select("zipcode", "n_rows", (per_day * 1000).alias("slope"), "sigma")


@query("f06_additive_weekly", f"""
    SELECT zipcode, ds, greatest(p, 0) AS yhat, greatest(p - {Z90!r}::DOUBLE * sigma, 0) AS yhat_lower, p + {Z90!r}::DOUBLE * sigma AS yhat_upper FROM (
        SELECT zipcode, ds, sigma, w.y + slope * ((ds - DATE '1970-01-01')::DOUBLE - w.day) AS p
        FROM (SELECT zipcode, CAST(max(date) + CAST(i AS INTEGER) AS DATE) AS ds FROM trained, range(1, {P.FORECAST_HORIZON + 1}) AS r(i) GROUP BY zipcode, i) AS t
        JOIN weekly_line USING (zipcode) JOIN (SELECT zipcode AS z, weekday, day, y FROM weekdays) AS w ON w.z = zipcode AND w.weekday = dayofweek(ds)) AS q""",
       needs=["weekly_line", "weekdays"], doubles=["yhat", "yhat_lower", "yhat_upper"], digits=5)
def f06_weekly(spark, folder):
    rows, models = weekly_line(spark, folder)
    return forecast.predict(models, forecast.future_frame(rows, history=False))


@query("f06_seasonal_rows")
def f06_rows(spark, folder):
    """The forecast itself, with its interval; held against a plain fit in the tests."""
    rows = forecast.forecast_frame(clean.split(cleaned(spark, folder))[0])
    return forecast.predict(forecast.fit(rows), forecast.future_frame(rows, history=False))


@query("f06_seasonal_forecast", f"""SELECT zipcode, CAST(last + CAST(i AS INTEGER) AS DATE) AS ds, true AS finite, true AS ordered
    FROM (SELECT zipcode, max(date) AS last FROM trained GROUP BY zipcode) AS t, range(1, {P.FORECAST_HORIZON + 1}) AS r(i)""", needs=["trained"])
def f06_seasonal(spark, folder):
    train = clean.split(cleaned(spark, folder))[0]
    rows = forecast.forecast_frame(train)
    ahead = forecast.predict(forecast.fit(rows), forecast.future_frame(rows, history=False))
    # the numbers are a numerical fit; SQL knows which days there are, and that the interval encloses the forecast
    finite = F.abs(F.col("yhat_lower")) + F.abs(F.col("yhat")) + F.abs(F.col("yhat_upper")) < F.lit(1e12)
    ordered = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return ahead.select("zipcode", "ds", finite.alias("finite"), ordered.alias("ordered"))


@query("f07_evaluate_regions", """SELECT 'line' AS model, zipcode, count(*) AS n_samples, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
    avg(abs((y - yhat) / (abs(y) + 1))) * 100 AS mape FROM line_forecast GROUP BY zipcode""", needs=["line_forecast"], doubles=["mae", "rmse", "mape"], digits=4)
def f07(spark, folder):
    test = split_panel(spark, folder)[2]
    pairs = metrics.align(line_forecast(spark, folder), test).withColumn("model", F.lit("line"))
    return metrics.evaluate(pairs, digits=9)


@query("f12_seasonal_naive", "SELECT zipcode, ds, yhat FROM naive", needs=["naive"], doubles=["yhat"])
def f12(spark, folder):
    return forecast.seasonal_naive(panel(spark, folder, "er_visits"))


@query("j08_forecast_actual", "SELECT zipcode, ds, y, yhat FROM naive", needs=["naive"], doubles=["y", "yhat"])
def j08(spark, folder):
    return naive_pairs(spark, folder)


@query("p09_forecast_line", """
    SELECT zipcode, date AS ds, er_visits AS y FROM labelled JOIN (SELECT zipcode, max(date) AS date FROM labelled WHERE split <> 'test' GROUP BY zipcode) AS e USING (zipcode, date)
    UNION ALL SELECT zipcode, ds, yhat FROM line_forecast""", needs=["line_forecast"], doubles=["y"], digits=5)
def p09(spark, folder):
    labelled = clean.label_split(panel(spark, folder, "er_visits"))
    return region.forecast_line(labelled.filter("split <> 'test'"), line_forecast(spark, folder))


@query("p10_forecast_band", """
    SELECT zipcode, 0 AS side, ds - DATE '1970-01-01' AS ord, ds, yhat_upper AS y FROM line_forecast
    UNION ALL SELECT zipcode, 1, -(ds - DATE '1970-01-01'), ds, yhat_lower FROM line_forecast ORDER BY 1, 2, 3""", needs=["line_forecast"], doubles=["y"], digits=5)
def p10(spark, folder):
    return region.forecast_band(line_forecast(spark, folder))


# --- global lag regression ----------------------------------------------------------


# SQL knows the rows of each part and that errors are ordered; the numbers of the wide fit are checked at lookback 1
BLOCKS["tested"] = (("labelled",), "SELECT * FROM labelled WHERE split = 'test'")
BLOCKS["sequences"] = (("trained",), f"""
    SELECT date FROM (SELECT date, row_number() OVER ({BY_DATE}) AS rank FROM trained) AS r WHERE rank > {P.LOOKBACK}""")
LAG_CUT = "min(date) + CAST(floor((max(date) - min(date)) * 0.8::DOUBLE) AS INTEGER)"
TESTED_SEQUENCES = f"CAST(sum(n) AS BIGINT) FROM (SELECT greatest(count(*) - {P.LOOKBACK}, 0) AS n FROM tested GROUP BY zipcode) AS t"


def in_order(results):
    return (F.col("mae") <= F.col("rmse")) & (F.col("mape") >= 0)


@query("f08_lag_regression", f"""
    SELECT CASE WHEN date <= (SELECT {LAG_CUT} FROM sequences) THEN 'train' ELSE 'validation' END AS split, count(*) AS n_samples, true AS in_order
    FROM sequences GROUP BY 1""", needs=["sequences"])
def f08(spark, folder):
    train, _, _ = clean.split(cleaned(spark, folder))
    history = lag_regression.fit(train)[1]
    return history.select("split", "n_samples", in_order(history).alias("in_order"))


@query("f08_lag_errors")
def f08_errors(spark, folder):
    return lag_regression.fit(clean.split(cleaned(spark, folder))[0])[1]


@query("f10_sequence_errors")
def f10_errors(spark, folder):
    train, _, test = clean.split(cleaned(spark, folder))
    return lag_regression.evaluate_sequences(lag_regression.fit(train)[0], test)


@query("f11_forecast_errors")
def f11_errors(spark, folder):
    train, _, test = clean.split(cleaned(spark, folder))
    return forecasting.run(train, test).results


BLOCKS["global_ends"] = (("trained",), f"SELECT zipcode, max(date) AS last FROM trained GROUP BY zipcode HAVING count(*) >= {P.LOOKBACK}")


@query("f09_recursive_forecast", f"""SELECT zipcode, CAST(last + CAST(k AS INTEGER) AS DATE) AS ds, true AS valid
    FROM global_ends, range(1, {P.FORECAST_HORIZON + 1}) AS r(k)""", needs=["global_ends"])
def f09(spark, folder):
    train, _, _ = clean.split(cleaned(spark, folder))
    model, _ = lag_regression.fit(train)
    return lag_regression.forecast(model, train).select("zipcode", "ds", F.col("yhat").between(0, 1e12).alias("valid"))


@query("f10_sequence_metrics", f"SELECT 'lag_regression' AS model, {TESTED_SEQUENCES.replace(' FROM', ' AS n_samples, true AS in_order FROM', 1)}", needs=["tested"])
def f10(spark, folder):
    train, _, test = clean.split(cleaned(spark, folder))
    model, _ = lag_regression.fit(train)
    results = lag_regression.evaluate_sequences(model, test)
    return results.select("model", "n_samples", in_order(results).alias("in_order"))


@query("f11_forecast_job", f"""SELECT 'seasonal' AS model, zipcode, count(*) AS n_samples, true AS in_order FROM tested GROUP BY zipcode
    UNION ALL SELECT 'lag_regression', 'all', {TESTED_SEQUENCES.replace(' FROM', ', true FROM', 1)}""", needs=["trained", "tested"])
def f11(spark, folder):
    train, _, test = clean.split(cleaned(spark, folder))
    results = forecasting.run(train, test).results
    return results.select("model", "zipcode", "n_samples", in_order(results).alias("in_order"))


# --- the same regression on one signal and one earlier day, which is a line ------------


def one_day(source: str) -> str:
    return f"""SELECT * FROM (SELECT zipcode, date, lag(er_visits) OVER ({BY_DATE}) AS x, er_visits AS y FROM {source}) AS p WHERE x IS NOT NULL"""


BLOCKS["train_pairs"] = (("trained",), one_day("trained"))
BLOCKS["test_pairs"] = (("tested",), one_day("tested"))
BLOCKS["pair_cut"] = (("train_pairs",), f"SELECT {LAG_CUT} AS cut FROM train_pairs")
BLOCKS["lag_line"] = (("train_pairs", "pair_cut"), "SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM train_pairs, pair_cut WHERE date <= cut")
LINE_ERRORS = """count(*) AS n_samples, round(avg(abs(y - yhat)), 4) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse,
    round(avg(abs((y - yhat) / (abs(y) + 1))) * 100, 4) AS mape"""
LINE_AHEAD = f"""SELECT zipcode, CAST(last + CAST(k AS INTEGER) AS DATE) AS ds, greatest(power(b, k) * y + a * (1 - power(b, k)) / (1 - b), 0) AS yhat
    FROM (SELECT zipcode, max(date) AS last, arg_max(er_visits, date) AS y FROM trained GROUP BY zipcode) AS e, lag_line, range(1, {P.FORECAST_HORIZON + 1}) AS r(k)"""


def fitted_line(train):
    return lag_regression.fit(train, (P.TARGET,), lookback=1, ridge=0.0)


@query("f08_lag_line", f"""SELECT split, {LINE_ERRORS} FROM (
    SELECT CASE WHEN date <= cut THEN 'train' ELSE 'validation' END AS split, y, a + b * x AS yhat FROM train_pairs, pair_cut, lag_line) AS p GROUP BY split""",
       needs=["lag_line"], doubles=["mae", "rmse", "mape"])
def f08_line(spark, folder):
    return fitted_line(clean.split(cleaned(spark, folder))[0])[1]


@query("f09_lag_line_forecast", LINE_AHEAD, needs=["lag_line"], doubles=["yhat"], digits=5)
def f09_line(spark, folder):
    train = clean.split(cleaned(spark, folder))[0]
    return lag_regression.forecast(fitted_line(train)[0], train)


@query("f10_lag_line_metrics", f"SELECT 'lag_regression' AS model, {LINE_ERRORS} FROM (SELECT y, a + b * x AS yhat FROM test_pairs, lag_line) AS p",
       needs=["lag_line", "test_pairs"], doubles=["mae", "rmse", "mape"])
def f10_line(spark, folder):
    train, _, test = clean.split(cleaned(spark, folder))
    return lag_regression.evaluate_sequences(fitted_line(train)[0], test)
