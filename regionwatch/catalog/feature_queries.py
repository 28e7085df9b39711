"""Window features, scores, regional aggregates and dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import calendar, scores as score_functions, windows
from ..operators import clean, features, merge, metrics, region, scaling, sequences
from ..plans import dashboard
from ..plans.jobs import feature_job
from ..session import reuse
from ..sources import derived
from . import base
from .base import BLOCKS, BY_DATE, cleaned, featured, merged, query

SIGNALS5 = list(P.LAG_COLUMNS)


def panel(spark, folder, *columns):
    return cleaned(spark, folder).select("date", "zipcode", *columns)


# --- windows -------------------------------------------------------------------

LAGS = {f"{c}_lag_{k}": base.lag_sql(c, k) for c in P.LAG_COLUMNS for k in P.LAG_DAYS}


def named(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in expressions.items())


@query("w01_lag", f"SELECT date, zipcode, {named(LAGS)} FROM clean", needs=["clean"], doubles=list(LAGS))
def w01(spark, folder):
    df = panel(spark, folder, *SIGNALS5)
    return df.withColumns(windows.lags(SIGNALS5)).drop(*SIGNALS5)


def rolling_query(name: str, stat: str):
    cells = {f"{c}_roll_{n}_{stat}": base.rolling_sql(c, n, stat) for c in P.ROLLING_COLUMNS for n in P.ROLLING_WINDOWS}

    @query(name, f"SELECT date, zipcode, {named(cells)} FROM clean", needs=["clean"], doubles=list(cells))
    def rolled(spark, folder):
        df = panel(spark, folder, *SIGNALS5)
        return df.withColumns(windows.rolling(P.ROLLING_COLUMNS, stats=[stat])).drop(*SIGNALS5)


for _name, _stat in (("w02_rolling_mean", "mean"), ("w03_rolling_std", "std"), ("w04_rolling_max", "max"),
                     ("w05_rolling_min", "min"), ("w06_rolling_sum", "sum")):
    rolling_query(_name, _stat)


CHANGES = {f"{c}_pct_change_{p}": base.change_sql(c, f"{c}_{p}") for c in P.CHANGE_COLUMNS for p in P.CHANGE_PERIODS}
PADDED = ", ".join(f"last_value({c} IGNORE NULLS) {base.RUNNING} AS {c}" for c in P.CHANGE_COLUMNS)
BEFORE = ", ".join(f"{base.lag_sql(c, p)} AS {c}_{p}" for c in P.CHANGE_COLUMNS for p in P.CHANGE_PERIODS)


@query("w07_pct_change", f"""SELECT date, zipcode, {named(CHANGES)} FROM (SELECT date, zipcode, {', '.join(P.CHANGE_COLUMNS)}, {BEFORE}
    FROM (SELECT date, zipcode, {PADDED} FROM numbers) AS p) AS b""", needs=["numbers"], doubles=list(CHANGES))
def w07(spark, folder):
    rows = clean.fix_types(merged(spark, folder)).select("date", "zipcode", *P.CHANGE_COLUMNS)
    return features.with_pct_changes(rows).drop(*P.CHANGE_COLUMNS)


@query("w08_rolling_zscore", f"SELECT date, zipcode, {', '.join(c + '_zscore' for c in P.ANOMALY_COLUMNS)} FROM zscored",
       needs=["zscored"], doubles=[f"{c}_zscore" for c in P.ANOMALY_COLUMNS])
def w08(spark, folder):
    df = panel(spark, folder, *P.ANOMALY_COLUMNS)
    return df.select("date", "zipcode", *[windows.rolling_zscore(c).alias(f"{c}_zscore") for c in P.ANOMALY_COLUMNS])


@query("w09_anomaly_flags", f"SELECT date, zipcode, {', '.join(c + '_anomaly' for c in P.ANOMALY_COLUMNS)} FROM flagged", needs=["flagged"])
def w09(spark, folder):
    df = windows.with_zscore_anomalies(panel(spark, folder, *P.ANOMALY_COLUMNS))
    return df.select("date", "zipcode", *[f"{c}_anomaly" for c in P.ANOMALY_COLUMNS])


@query("w10_strict_zscore", f"""SELECT * FROM (SELECT date, zipcode, pharmacy_sales, {base.zscore_sql('pharmacy_sales', 30, 30, 0.0)} AS pharmacy_zscore FROM clean) AS z
    WHERE abs(pharmacy_zscore) > 2.5""", needs=["clean"], doubles=["pharmacy_sales", "pharmacy_zscore"])
def w10(spark, folder):
    z = panel(spark, folder, "pharmacy_sales").withColumn("pharmacy_zscore", windows.strict_zscore("pharmacy_sales"))
    return z.filter(windows.flag(F.col("pharmacy_zscore")) == 1)


RESIDUAL_PARTS = {
    "trended": ("avg({c}) OVER (" + BY_DATE + " ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS {c}_trend", f"row_number() OVER ({BY_DATE}) % 7 AS phase, count(*) OVER (PARTITION BY zipcode) AS n", "clean"),
    "phased": ("avg({c} - {c}_trend) OVER (PARTITION BY zipcode, phase) AS {c}_seasonal", "", "trended"),
    "residuals": ("CASE WHEN n >= 14 THEN {c} - {c}_trend - ({c}_seasonal - avg({c}_seasonal) OVER (PARTITION BY zipcode)) ELSE 0 END AS {c}_stl_resid", "", "phased"),
    "residual_scores": ("{c}_stl_resid / (coalesce(stddev_samp({c}_stl_resid) OVER (PARTITION BY zipcode), 1) + 1e-8) AS {c}_zscore", "", "residuals"),
}
for _name, (_each, _more, _source) in RESIDUAL_PARTS.items():
    _columns = ", ".join([_each.format(c=c) for c in P.ANOMALY_COLUMNS] + [_more] * bool(_more))
    BLOCKS[_name] = ((_source,), f"SELECT *, {_columns} FROM {_source}")
RESIDUALS = [f"{c}_stl_resid" for c in P.ANOMALY_COLUMNS]
SEASONAL_SCORES = [f"{c}_zscore" for c in P.ANOMALY_COLUMNS]


def seasonal_flags(threshold: float) -> str:
    return ", ".join(f"CASE WHEN abs({c}_zscore) > {threshold} THEN 1 ELSE 0 END AS {c}_anomaly" for c in P.ANOMALY_COLUMNS)


@query("w11_seasonal_residual", f"SELECT date, zipcode, {', '.join(RESIDUALS)} FROM residuals", needs=["residuals"], doubles=RESIDUALS)
def w11(spark, folder):
    return windows.seasonal_residuals(panel(spark, folder, *P.ANOMALY_COLUMNS), P.ANOMALY_COLUMNS).drop(*P.ANOMALY_COLUMNS)


@query("w12_residual_anomaly", f"SELECT date, zipcode, {', '.join(SEASONAL_SCORES)}, {seasonal_flags(2.5)} FROM residual_scores",
       needs=["residual_scores"], doubles=SEASONAL_SCORES)
def w12(spark, folder):
    scored = windows.seasonal_anomalies(panel(spark, folder, *P.ANOMALY_COLUMNS), P.ANOMALY_COLUMNS)
    return scored.select("date", "zipcode", *SEASONAL_SCORES, *[f"{c}_anomaly" for c in P.ANOMALY_COLUMNS])


SEQ = ("pharmacy_sales", "aqi")
SEQ_FRAME = f"OVER ({BY_DATE} ROWS BETWEEN {P.LOOKBACK} PRECEDING AND 1 PRECEDING)"


@query("w13_lookback_sequences", f"""
    SELECT zipcode, date, y, len(p) AS steps, list_sum(p) AS sum_pharmacy, list_sum(a) AS sum_aqi, p[1] AS oldest, p[-1] AS newest FROM (
        SELECT zipcode, date, er_visits AS y, array_agg(pharmacy_sales) {SEQ_FRAME} AS p, array_agg(aqi) {SEQ_FRAME} AS a,
               row_number() OVER ({BY_DATE}) AS k FROM numbers
        WHERE pharmacy_sales IS NOT NULL AND aqi IS NOT NULL AND er_visits IS NOT NULL) AS s WHERE k > {P.LOOKBACK}""",
       needs=["numbers"], doubles=["y", "sum_pharmacy", "sum_aqi", "oldest", "newest"])
def w13(spark, folder):
    rows = clean.fix_types(merged(spark, folder))
    seqs = sequences.lookback_sequences(rows, SEQ)
    total = lambda i: F.aggregate("x", F.lit(0.0), lambda s, v: s + v[i])
    return seqs.select(
        "zipcode", "date", "y", F.size("x").alias("steps"), total(0).alias("sum_pharmacy"), total(1).alias("sum_aqi"),
        F.col("x")[0][0].alias("oldest"), F.element_at("x", -1)[0].alias("newest"),
    )


@query("w14_last_rows", f"""SELECT date, zipcode, er_visits FROM (SELECT date, zipcode, er_visits, row_number() OVER (PARTITION BY zipcode ORDER BY date DESC) AS k FROM clean) AS x
    WHERE k <= {P.LOOKBACK}""", needs=["clean"], doubles=["er_visits"])
def w14(spark, folder):
    return sequences.last_rows(panel(spark, folder, "er_visits"))


# --- scalar features and scores --------------------------------------------------

CAL = base.CALENDAR_SQL
DOUBLE_CAL = ["dow_sin", "dow_cos", "month_sin", "month_cos"]


def calendar_query(name: str, columns: list[str]):
    @query(name, "SELECT o_orderkey, date, " + named({c: CAL[c] for c in columns})
           + " FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders) AS o",
           doubles=[c for c in columns if c in DOUBLE_CAL])
    def fields(spark, folder):
        rows = derived.read(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
        every = calendar.calendar_columns()
        return rows.withColumns({c: every[c] for c in columns})


calendar_query("r01_calendar", ["day_of_week", "day_of_year", "month", "week_of_year", "year", "quarter", "is_weekend"])
calendar_query("r02_season", ["month", "season"])
calendar_query("r03_cyclical", DOUBLE_CAL)


@query("r04_seasonal_signal", "SELECT o_orderkey, 40 * cos(2 * pi() * (dayofyear(o_orderdate) - 15) / 365) AS signal FROM orders", doubles=["signal"])
def r04(spark, folder):
    day = F.to_date("o_orderdate")
    return derived.read(spark, folder, "orders").select("o_orderkey", calendar.seasonal_signal(day, 40, 15).alias("signal"))


GAPS = " ".join(f"WHEN aqi BETWEEN {lo} AND {hi} THEN '{label}'" for lo, (hi, label) in zip(
    [0] + [h + 1 for h, _ in P.AQI_CATEGORIES], P.AQI_CATEGORIES))


@query("r05_aqi_category", f"SELECT date, zipcode, aqi_category AS contiguous, CASE {GAPS} ELSE 'Hazardous' END AS gapped FROM air", needs=["air"])
def r05(spark, folder):
    rows = derived.air(spark, folder)
    return rows.select("date", "zipcode", F.col("aqi_category").alias("contiguous"), score_functions.aqi_category(F.col("aqi"), "reference").alias("gapped"))


def interaction_query(name: str, column: str, sql: str):
    @query(name, f"SELECT date, zipcode, {sql} AS {column} FROM clean", needs=["clean"], doubles=[column])
    def crossed(spark, folder):
        df = panel(spark, folder, "temperature_c", "aqi", "negative_sentiment", "pharmacy_sales", "humidity_pct")
        return score_functions.with_interactions(df).select("date", "zipcode", column)


SENTIMENT_SQL = "negative_sentiment * pharmacy_sales / (SELECT max(pharmacy_sales) FROM clean)"
interaction_query("r06_temp_x_aqi", "temp_x_aqi", "abs(temperature_c - 18) * aqi / 100")
interaction_query("r07_sentiment_x_pharmacy", "sentiment_x_pharmacy", SENTIMENT_SQL)
interaction_query("r08_heat_index", "heat_index", base.HEAT_SQL)


def scaled_sql(x: str) -> str:
    return f"({x} - (SELECT min({x}) FROM clean)) / (SELECT max({x}) - min({x}) FROM clean)"


@query("r09_minmax", f"SELECT date, zipcode, {scaled_sql('pharmacy_sales')} AS pharmacy_sales, {scaled_sql('aqi')} AS aqi, 0.0::DOUBLE AS constant FROM clean",
       needs=["clean"], doubles=["pharmacy_sales", "aqi", "constant"])
def r09(spark, folder):
    values = {"pharmacy_sales": F.col("pharmacy_sales"), "aqi": F.col("aqi"), "constant": F.lit(7.0)}
    bounded, out = score_functions.with_minmax(panel(spark, folder, "pharmacy_sales", "aqi"), values)
    return bounded.select("date", "zipcode", *[c.alias(n) for n, c in out.items()])


@query("r10_temperature_extremity", f"SELECT date, zipcode, {scaled_sql('abs(temperature_c - 18)')} AS temp_extreme FROM clean", needs=["clean"], doubles=["temp_extreme"])
def r10(spark, folder):
    bounded, out = score_functions.with_minmax(
        panel(spark, folder, "temperature_c"), {"temp_extreme": score_functions.temperature_extremity(F.col("temperature_c"))}
    )
    return bounded.select("date", "zipcode", out["temp_extreme"].alias("temp_extreme"))


@query("r11_anomaly_count", f"""SELECT date, zipcode, {base.FLAG_SUM} AS anomalies,
    {base.minmax_sql(base.FLAG_SUM, 'lo_anomaly_count', 'hi_anomaly_count')} AS scaled FROM flagged, bounds""", needs=["flagged", "bounds"], doubles=["scaled"])
def r11(spark, folder):
    df = windows.with_zscore_anomalies(panel(spark, folder, *P.ANOMALY_COLUMNS))
    count = score_functions.anomaly_count(df)
    bounded, out = score_functions.with_minmax(df, {"scaled": count})
    return bounded.select("date", "zipcode", count.cast("bigint").alias("anomalies"), out["scaled"].alias("scaled"))


@query("r12_risk_score", "SELECT date, zipcode, disease_risk_score FROM scored", needs=["scored"], doubles=["disease_risk_score"])
def r12(spark, folder):
    return featured(spark, folder).select("date", "zipcode", "disease_risk_score")


LEVEL_SQL = "CASE WHEN score < 0.33 THEN 'Low' WHEN score < 0.66 THEN 'Medium' ELSE 'High' END"
SCORED_ORDERS = "(SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE) / 500000, 2) AS score FROM orders) AS o"


def scored_orders(spark, folder):
    return derived.read(spark, folder, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 500000, 2).alias("score"))


@query("r13_risk_level", f"SELECT o_orderkey, {LEVEL_SQL} AS risk_level FROM {SCORED_ORDERS}")
def r13(spark, folder):
    return scored_orders(spark, folder).select("o_orderkey", score_functions.risk_level(F.col("score")).alias("risk_level"))


@query("r14_risk_color", f"""SELECT o_orderkey, CASE level WHEN 'Low' THEN '#2ecc71' WHEN 'Medium' THEN '#f39c12' WHEN 'High' THEN '#e74c3c' ELSE '#95a5a6' END AS risk_color
    FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'none' ELSE {LEVEL_SQL} END AS level
    FROM (SELECT o_orderkey, o_orderpriority, round(CAST(o_totalprice AS DOUBLE) / 500000, 2) AS score FROM orders) AS o) AS l""")
def r14(spark, folder):
    level = F.when(F.col("o_orderpriority") == "5-LOW", "none").otherwise(score_functions.risk_level(F.round(F.col("o_totalprice") / 500000, 2)))
    return derived.read(spark, folder, "orders").select("o_orderkey", score_functions.risk_color(level).alias("risk_color"))


SCALED = ["pharmacy_sales", "aqi"]
STANDARD = ", ".join(f"({c} - (SELECT avg({c}) FROM clean)) / (SELECT stddev_pop({c}) FROM clean) AS {c}" for c in SCALED)


@query("r15_standard_scaler", f"SELECT date, zipcode, {STANDARD} FROM clean", needs=["clean"], doubles=SCALED)
def r15(spark, folder):
    df = panel(spark, folder, *SCALED)
    return scaling.transform(df, scaling.fit(df, SCALED), SCALED)


@query("r15_minmax_scaler_inverse", f"SELECT date, zipcode, {', '.join(SCALED)} FROM clean", needs=["clean"], doubles=SCALED)
def r15_inverse(spark, folder):
    df = panel(spark, folder, *SCALED)
    params = scaling.fit(df, SCALED, "minmax")
    return scaling.inverse(scaling.transform(df, params, SCALED), params, SCALED)


# --- metrics over a weekly naive forecast ----------------------------------------

BLOCKS["naive"] = (("clean",), f"SELECT zipcode, date AS ds, er_visits AS y, lag(er_visits, 7) OVER ({BY_DATE}) AS yhat FROM clean")
BLOCKS["pairs"] = (("naive",), "SELECT * FROM naive WHERE y IS NOT NULL AND yhat IS NOT NULL")
MAE, RMSE, MAPE = "avg(abs(y - yhat))", "sqrt(avg((y - yhat) * (y - yhat)))", "avg(abs((y - yhat) / (abs(y) + 1))) * 100"


def naive_pairs(spark, folder):
    from ..operators import forecast

    rows = panel(spark, folder, "er_visits")
    return metrics.align(forecast.seasonal_naive(rows), rows)


def metric_query(name: str, wanted: dict[str, str]):
    @query(name, f"SELECT zipcode, count(*) AS n_samples, {named(wanted)} FROM pairs GROUP BY zipcode", needs=["pairs"], doubles=list(wanted), digits=4)
    def measured(spark, folder):
        return metrics.evaluate(naive_pairs(spark, folder), ["zipcode"], metrics=list(wanted), digits=9)


metric_query("r16_mae", {"mae": MAE})
metric_query("r17_rmse", {"rmse": RMSE})
metric_query("r18_mape", {"mape": MAPE})


@query("r19_metric_set", f"SELECT 'naive' AS model, zipcode, count(*) AS n_samples, {MAE} AS mae, {MAPE} AS mape FROM pairs GROUP BY zipcode", needs=["pairs"], doubles=["mae", "mape"], digits=4)
def r19(spark, folder):
    named_pairs = naive_pairs(spark, folder).withColumn("model", F.lit("naive"))
    return metrics.evaluate(named_pairs, metrics=["mae", "unknown", "mape"], digits=9)


# --- regional aggregates ----------------------------------------------------------

SNAPSHOT_SQL = ("SELECT zipcode, " + ", ".join(f"avg({c}) AS {c}" for c in region.SNAPSHOT_MEANS) + ", "
                + ", ".join(f"sum({c}) AS {c}" for c in region.SNAPSHOT_SUMS)
                + ", min(lat) AS lat, min(lon) AS lon, min(city) AS city, min(state) AS state FROM {} GROUP BY zipcode")


@query("a01_region_snapshot", SNAPSHOT_SQL.format("recent30"), needs=["recent30"], doubles=region.SNAPSHOT_MEANS)
def a01(spark, folder):
    return region.snapshot(featured(spark, folder), 30)


@query("a01_region_snapshot_all", SNAPSHOT_SQL.format("scored"), needs=["scored"], doubles=region.SNAPSHOT_MEANS)
def a01_all(spark, folder):
    return region.snapshot(featured(spark, folder))


@query("entry_region_risk", "SELECT zipcode, city, state, disease_risk_score, er_visits, CASE WHEN disease_risk_score < 0.33 THEN 'Low' WHEN disease_risk_score < 0.66 THEN 'Medium' ELSE 'High' END AS risk_level FROM summary",
       needs=["summary"], doubles=["disease_risk_score", "er_visits"])
def entry_region_risk(spark, folder):
    snap = region.snapshot(featured(spark, folder), 30)
    return snap.select("zipcode", "city", "state", "disease_risk_score", "er_visits").withColumn(
        "risk_level", score_functions.risk_level(F.col("disease_risk_score"))
    )


@query("a02_map_summary", "SELECT * FROM levels", needs=["levels"], doubles=region.MAP_MEANS)
def a02(spark, folder):
    return region.map_summary(featured(spark, folder))


@query("p07_risk_filter", "SELECT zipcode, risk_level FROM levels WHERE risk_level IN ('High', 'Medium')", needs=["levels"])
def p07(spark, folder):
    return region.filter_levels(region.map_summary(featured(spark, folder)), ["High", "Medium"]).select("zipcode", "risk_level")


@query("p08_anomaly_rows", "SELECT zipcode, date, er_visits FROM flagged WHERE er_visits_anomaly = 1", needs=["flagged"], doubles=["er_visits"])
def p08(spark, folder):
    df = windows.with_zscore_anomalies(panel(spark, folder, "er_visits"), ["er_visits"])
    return region.anomaly_rows(df)


@query("p12_top_risk_series", """
    SELECT date, zipcode, er_visits FROM clean WHERE zipcode = (SELECT zipcode FROM (
        SELECT zipcode, max(er_visits) AS disease_risk_score FROM clean GROUP BY zipcode) AS s ORDER BY disease_risk_score DESC, zipcode LIMIT 1) ORDER BY date""",
       needs=["clean"], doubles=["er_visits"])
def p12(spark, folder):
    # peak visits stand in for the score, so that the data has a High region
    df = panel(spark, folder, "er_visits")
    peaks = df.groupBy("zipcode").agg(F.max("er_visits").alias("disease_risk_score"))
    levels = peaks.withColumn("risk_level", score_functions.risk_level(F.col("disease_risk_score")))
    return region.top_risk_series(df, levels).orderBy("date")


@query("a03_risk_distribution", """SELECT ord, d.risk_level, count(l.zipcode) AS n FROM (VALUES (0, 'High'), (1, 'Medium'), (2, 'Low')) AS d(ord, risk_level)
    LEFT JOIN levels AS l ON l.risk_level = d.risk_level GROUP BY ord, d.risk_level ORDER BY ord""", needs=["levels"])
def a03(spark, folder):
    return region.risk_distribution(region.map_summary(featured(spark, folder)))


@query("a04_kpis", """SELECT avg(er_visits) AS avg_er_visits, avg(aqi) AS avg_aqi, avg(negative_sentiment) AS avg_negative_sentiment,
    (SELECT count(*) FROM levels WHERE risk_level = 'High') AS n_high FROM recent30""", needs=["recent30", "levels"], doubles=["avg_er_visits", "avg_aqi", "avg_negative_sentiment"])
def a04(spark, folder):
    df = featured(spark, folder)
    return region.kpis(df, region.map_summary(df))


BLOCKS["recent60"] = (("scored", "last_day"), "SELECT scored.* FROM scored, last_day WHERE date >= last - 60")
BLOCKS["top10"] = (("recent60",), "SELECT zipcode, avg(disease_risk_score) AS s FROM recent60 GROUP BY zipcode ORDER BY s DESC, zipcode LIMIT 10")


def scores(spark, folder):
    """Score once: the heat map reads these three columns several times."""
    return reuse(featured(spark, folder).select("date", "zipcode", "disease_risk_score"))


@query("a05_risk_heatmap", """SELECT t.zipcode, d.date, coalesce(avg(r.disease_risk_score), 0) AS disease_risk_score FROM top10 AS t
    CROSS JOIN (SELECT DISTINCT date FROM recent60) AS d LEFT JOIN recent60 AS r ON r.zipcode = t.zipcode AND r.date = d.date GROUP BY 1, 2""",
       needs=["top10"], doubles=["disease_risk_score"])
def a05(spark, folder):
    return region.risk_heatmap(scores(spark, folder), 10)


AGES = [str(d) for d in range(61)]


@query("a05_risk_heatmap_wide", "SELECT zipcode, " + ", ".join(
    f"""coalesce(avg(disease_risk_score) FILTER (last - date = {d}), 0) AS "{d}" """ for d in AGES)
    + " FROM recent60 JOIN top10 USING (zipcode), last_day GROUP BY zipcode ORDER BY zipcode", needs=["recent60", "top10"], doubles=[f'"{d}"' for d in AGES])
def a05_wide(spark, folder):
    return region.risk_heatmap_wide(scores(spark, folder), 10)


@query("a06_top_regions", "SELECT zipcode, avg(disease_risk_score) AS disease_risk_score FROM scored GROUP BY zipcode ORDER BY 2 DESC, 1 LIMIT 10", needs=["scored"], doubles=["disease_risk_score"])
def a06(spark, folder):
    return region.top_regions(featured(spark, folder), 10)


@query("a07_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM clean WHERE zipcode = '10002'" for a in region.CORRELATED for b in region.CORRELATED),
    needs=["clean"], doubles=["corr"])
def a07(spark, folder):
    return region.correlation_matrix(cleaned(spark, folder), "10002")


CORR_FEATURES = [c for c in (*base.NUMERIC, "lat", "lon") if c != P.TARGET]


@query("a08_target_correlations", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, er_visits)) AS abs_corr FROM clean" for c in CORR_FEATURES) + ") AS c ORDER BY abs_corr DESC, feature LIMIT 20",
    needs=["clean"], doubles=["abs_corr"])
def a08(spark, folder):
    return region.target_correlations(cleaned(spark, folder))


@query("a09_region_means", "SELECT zipcode, avg(pharmacy_sales) AS pharmacy_sales FROM clean GROUP BY zipcode ORDER BY 2 DESC", needs=["clean"], doubles=["pharmacy_sales"])
def a09(spark, folder):
    return region.region_means(cleaned(spark, folder))


METRICS_SQL = f"SELECT 'naive' AS model, zipcode AS region, count(*) AS n_samples, round({MAE}, 4) AS mae, round({RMSE}, 4) AS rmse, round({MAPE}, 4) AS mape FROM pairs GROUP BY zipcode"


def naive_results(spark, folder):
    pairs = naive_pairs(spark, folder).withColumns({"model": F.lit("naive"), "region": F.col("zipcode")})
    return metrics.evaluate(pairs, ["model", "region"])


@query("a10_evaluation_summary", f"SELECT model, avg(n_samples) AS n_samples, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape FROM ({METRICS_SQL}) AS m GROUP BY model",
       needs=["pairs"], doubles=["n_samples", "mae", "rmse", "mape"], digits=4)
def a10(spark, folder):
    return metrics.summary(naive_results(spark, folder))


@query("a13_score_histogram", "SELECT zipcode, CAST(least(floor(disease_risk_score * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM scored GROUP BY 1, 2", needs=["scored"])
def a13(spark, folder):
    return region.score_histogram(featured(spark, folder))


@query("a14_date_range", "SELECT min(date) AS start, max(date) AS \"end\" FROM merged", needs=["merged"])
def a14(spark, folder):
    return region.date_range(merged(spark, folder))


@query("a15_metric_means", f"SELECT avg(coalesce(mae, 0)) AS avg_mae, avg(coalesce(rmse, 0)) AS avg_rmse FROM ({METRICS_SQL}) AS m", needs=["pairs"], doubles=["avg_mae", "avg_rmse"], digits=4)
def a15(spark, folder):
    return metrics.overall(naive_results(spark, folder))


# --- jobs -------------------------------------------------------------------------

ROLLED = {f"{c}_roll_{n}_{s}": base.rolling_sql(c, n, s) for c in P.ROLLING_COLUMNS for n in P.ROLLING_WINDOWS for s in P.ROLLING_STATS}
SHIFTED = {f"{c}_pct_change_{p}": base.change_sql(c, f"({base.lag_sql(c, p)})") for c in P.CHANGE_COLUMNS for p in P.CHANGE_PERIODS}
CROSSED = {"temp_x_aqi": "abs(temperature_c - 18) * aqi / 100", "sentiment_x_pharmacy": SENTIMENT_SQL, "heat_index": base.HEAT_SQL}
NEW_DOUBLES = [*DOUBLE_CAL, *LAGS, *ROLLED, *SHIFTED, *CROSSED, *[f"{c}_zscore" for c in P.ANOMALY_COLUMNS], "disease_risk_score"]


@query("e03_features", f"""SELECT * FROM (SELECT *, {named({**CAL, **LAGS, **ROLLED, **SHIFTED, **CROSSED})} FROM scored) AS s WHERE er_visits IS NOT NULL""",
       needs=["scored"], doubles=[*base.NUMERIC, "lat", "lon", *NEW_DOUBLES], digits=5)
def e03(spark, folder):
    return featured(spark, folder)


OTHER_LAGS = {f"{c}_lag_{k}": base.lag_sql(c, k) for c in P.LAG_COLUMNS for k in (2, 5)}
OTHER_ROLLS = {f"{c}_roll_10_{s}": base.rolling_sql(c, 10, s) for c in P.ROLLING_COLUMNS for s in ("mean", "max")}
OTHER_FLAGS = ", ".join(f"{base.flag_sql(c + '_zscore', 1.5)} AS {c}_anomaly" for c in P.ANOMALY_COLUMNS)


@query("e03_features_custom", f"SELECT date, zipcode, {named({**OTHER_LAGS, **OTHER_ROLLS})}, {OTHER_FLAGS} FROM zscored WHERE aqi IS NOT NULL",
       needs=["zscored"], doubles=[*OTHER_LAGS, *OTHER_ROLLS], digits=5)
def e03_custom(spark, folder):
    made = feature_job(
        cleaned(spark, folder), lag_days=(2, 5), rolling_windows=(10,), rolling_stats=("mean", "max"), anomaly_threshold=1.5, target="aqi"
    )
    return made.select("date", "zipcode", *OTHER_LAGS, *OTHER_ROLLS, *[f"{c}_anomaly" for c in P.ANOMALY_COLUMNS])


@query("e03_features_seasonal", f"SELECT date, zipcode, {', '.join(SEASONAL_SCORES)}, {seasonal_flags(2.0)} FROM residual_scores WHERE er_visits IS NOT NULL",
       needs=["residual_scores"], doubles=SEASONAL_SCORES)
def e03_seasonal(spark, folder):
    made = feature_job(cleaned(spark, folder), anomaly_method="seasonal", anomaly_threshold=2.0)
    return made.select("date", "zipcode", *SEASONAL_SCORES, *[f"{c}_anomaly" for c in P.ANOMALY_COLUMNS])


@query("e05_dashboard_tables", """
    SELECT 'summary' AS name, count(*) AS n FROM levels UNION ALL SELECT 'distribution', 3 UNION ALL SELECT 'kpis', 1
    UNION ALL SELECT 'heatmap', (SELECT count(DISTINCT zipcode) FROM recent60) * (SELECT count(DISTINCT date) FROM recent60)
    UNION ALL SELECT 'anomalies', count(*) FROM flagged WHERE er_visits_anomaly = 1
    UNION ALL SELECT 'signals', 3 * count(*) FROM clean UNION ALL SELECT 'regions', count(DISTINCT zipcode) FROM clean""",
       needs=["levels", "recent60", "flagged"])
def e05(spark, folder):
    tables = dashboard.tables(featured(spark, folder))
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
