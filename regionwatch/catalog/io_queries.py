"""Payloads, posts, sinks, streams and whole jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import params as P
from ..functions import windows
from ..operators import forecast, lag_regression, clean
from ..plans import full_run, jobs
from ..session import work_folder
from ..sources import derived, payloads, sinks, tables
from ..streaming import alerts, daily_panel
from . import base
from .base import cleaned, featured, query
from .forecast_queries import LINE_AHEAD, MODELS_SQL, fitted_line
from .hotspot_queries import WIDE, placed
from .panel_queries import values_apart


# --- landed payloads: built from the panel, then parsed ---------------------------


@query("s04_weather_payload", """SELECT date, zipcode, temperature_c, humidity_pct, wind_speed_kmh,
    CASE WHEN precipitation_mm > 5 THEN precipitation_mm * 24 ELSE 0 END AS precipitation_mm FROM weather""", needs=["weather"],
       doubles=["temperature_c", "humidity_pct", "wind_speed_kmh", "precipitation_mm"])
def s04(spark, folder):
    wet = F.when(F.col("precipitation_mm") > 5, F.struct(F.col("precipitation_mm").alias("1h")))
    now = F.struct(
        F.col("temperature_c").alias("temp"), F.col("humidity_pct").alias("humidity"),
        F.col("wind_speed_kmh").alias("wind_speed"), wet.alias("rain"),
    )
    landed = derived.weather(spark, folder).select("date", "zipcode", F.to_json(F.struct(now.alias("current"))).alias("payload"))
    return payloads.flatten_weather(landed)


@query("s05_air_payload", "SELECT date, zipcode, CAST(round(aqi) AS DOUBLE) AS aqi, CASE WHEN pm25_ugm3 < 60 THEN pm25_ugm3 END AS pm25_ugm3, 'Unknown' AS aqi_category FROM air", needs=["air"], doubles=["aqi", "pm25_ugm3"])
def s05(spark, folder):
    fine = F.when(F.col("pm25_ugm3") < 60, F.struct(F.col("pm25_ugm3").alias("conc")))
    pollution = F.struct(F.round("aqi").cast("int").alias("aqius"), fine.alias("p2"))
    nested = F.struct(F.struct(F.struct(pollution.alias("pollution")).alias("current")).alias("data"))
    landed = derived.air(spark, folder).select("date", "zipcode", F.to_json(nested).alias("payload"))
    return payloads.flatten_air(landed)


@query("s06_visits_payload", "SELECT date, zipcode, CASE WHEN er_visits > 10 THEN er_visits ELSE 0 END AS er_visits FROM er WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", needs=["er"])
def s06(spark, folder):
    # one payload per region and month; small counts are left out of it
    rows = derived.er_visits(spark, folder).select(
        "zipcode", F.trunc("date", "month").alias("month"),
        F.struct(F.col("date").cast("string").alias("date"), F.when(F.col("er_visits") > 10, F.col("er_visits")).alias("visit_count")).alias("r"),
    )
    landed = rows.groupBy("zipcode", "month").agg(F.to_json(F.collect_list("r")).alias("payload"))
    return payloads.flatten_visits(landed, "payload", "1996-01-01", "1999-12-31")


WORDS = ("thble", "thing", "attion")
HIT = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS) + ")"


def posts(spark, folder):
    return derived.read(spark, folder, "documents").select(
        "doc_id", "lang", "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date")
    )


@query("s07_daily_symptom_rate", f"""SELECT date, ((2 * hits * 10000 + n) // (2 * n)) / 10000 AS negative_sentiment, n AS post_volume,
    round(hits / n * 0.7, 4) AS symptom_mention_rate FROM (SELECT DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date, count(*) AS n, count(*) FILTER {'(WHERE ' + HIT + ')'} AS hits FROM documents GROUP BY 1) AS d""")
def s07(spark, folder):
    return payloads.daily_symptom_rate(posts(spark, folder), WORDS)


@query("s08_keyword_search", f"SELECT doc_id, lang FROM documents WHERE lang = 'en' AND {HIT}")
def s08(spark, folder):
    return payloads.search_posts(posts(spark, folder), WORDS).select("doc_id", "lang")


@query("s09_address_payload", "SELECT CAST(c_custkey AS VARCHAR) AS zipcode, c_acctbal AS lat, CAST(c_nationkey AS DOUBLE) AS lon, c_name AS city, c_mktsegment AS state FROM customer WHERE c_acctbal > 0", doubles=["lat", "lon"])
def s09_address(spark, folder):
    match = F.struct(
        F.struct(F.col("c_nationkey").alias("x"), F.col("c_acctbal").alias("y")).alias("coordinates"),
        F.struct(F.col("c_name").alias("city"), F.col("c_mktsegment").alias("state")).alias("addressComponents"),
    )
    matches = F.when(F.col("c_acctbal") > 0, F.array(match, match)).otherwise(F.array().cast("array<struct<coordinates:struct<x:int,y:double>,addressComponents:struct<city:string,state:string>>>"))
    landed = derived.read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("zipcode"),
        F.to_json(F.struct(F.struct(matches.alias("addressMatches")).alias("result"))).alias("payload"),
    )
    return payloads.flatten_address(landed)


@query("s09_place_payload", "SELECT CAST(c_custkey AS VARCHAR) AS zipcode, c_acctbal AS lat, CAST(c_nationkey AS DOUBLE) AS lon, c_name AS city, substr(c_mktsegment, 1, 2) AS state FROM customer", doubles=["lat", "lon"])
def s09_place(spark, folder):
    def part(kind, long, short):
        return F.struct(F.array(F.lit(kind), F.lit("political")).alias("types"), long.alias("long_name"), short.alias("short_name"))

    short = F.substring("c_mktsegment", 1, 2)
    place = F.struct(
        F.struct(F.struct(F.col("c_acctbal").alias("lat"), F.col("c_nationkey").alias("lng")).alias("location")).alias("geometry"),
        F.array(
            part("country", F.lit("United States"), F.lit("US")),
            part("locality", F.col("c_name"), F.col("c_name")),
            part("administrative_area_level_1", F.col("c_mktsegment"), short),
        ).alias("address_components"),
    )
    landed = derived.read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("zipcode"), F.to_json(F.struct(F.array(place).alias("results"))).alias("payload")
    )
    return payloads.flatten_place(landed)


# --- sinks: written to the shared folder and read back ------------------------------


@query("s10_table_sink", "SELECT date, zipcode, er_visits, aqi FROM clean", needs=["clean"], doubles=["er_visits", "aqi"])
def s10(spark, folder):
    rows = cleaned(spark, folder).select("date", "zipcode", "er_visits", "aqi")
    path = sinks.write_table(rows, work_folder(spark, "table"), ("zipcode",))
    return spark.read.schema("date date, er_visits double, aqi double, zipcode string").parquet(path)


@query("s11_report_sink", "SELECT * FROM report", needs=["report"], doubles=["number"])
def s11(spark, folder):
    job = jobs.preprocess(derived.long_sources(spark, folder), derived.panel_regions(spark), unique=True)
    paths = sinks.write_reports({"quality": job.report}, work_folder(spark, "reports"))
    return values_apart(spark.read.schema("section string, column string, metric string, value string").json(paths["quality"]))


MAP_TEXT = ("zipcode", "city", "state", "risk_level", "risk_color")
MAP_NUMBERS = ("cluster_id", "disease_risk_score", "er_visits_mean", "pharmacy_sales_mean", "negative_sentiment_mean", "aqi_mean", "cluster_probability")


MAP_SQL = """
    SELECT 'Feature' AS type, lon, lat, zipcode, city, state, risk_level, CASE risk_level WHEN 'Low' THEN '#2ecc71' WHEN 'Medium' THEN '#f39c12' ELSE '#e74c3c' END AS risk_color,
           CAST(cluster_id AS DOUBLE) AS cluster_id, round(score2, 4) AS disease_risk_score, round(er_visits, 2) AS er_visits_mean, round(pharmacy_sales, 2) AS pharmacy_sales_mean,
           round(negative_sentiment, 4) AS negative_sentiment_mean, round(aqi, 1) AS aqi_mean, 0.5::DOUBLE AS cluster_probability FROM placed"""


@query("s13_map_lines", MAP_SQL, needs=["placed"], doubles=["lon", "lat"])
def s13_lines(spark, folder):
    return parsed_features(spark.read.text(sinks.write_map(placed(spark, folder), work_folder(spark, "map"))))


@query("s13_map_document", MAP_SQL, needs=["placed"], doubles=["lon", "lat"])
def s13_document(spark, folder):
    lines = spark.read.text(sinks.write_map_document(placed(spark, folder), work_folder(spark, "map-document")))
    return parsed_features(lines.filter(F.col("value").contains('"Feature"')).select(F.ltrim("value", F.lit(",")).alias("value")))


def parsed_features(lines):
    at = lambda p: F.get_json_object("value", f"$.{p}")
    place = [at(f"geometry.coordinates[{i}]").cast("double").alias(c) for i, c in enumerate(("lon", "lat"))]
    texts = [at(f"properties.{c}").alias(c) for c in MAP_TEXT]
    numbers = [at(f"properties.{c}").cast("double").alias(c) for c in MAP_NUMBERS]
    return lines.select(at("type").alias("type"), *place, *texts, *numbers)


@query("s14_model_table", MODELS_SQL, needs=["clean"])
def s14(spark, folder):
    models = forecast.fit(forecast.forecast_frame(cleaned(spark, folder)))
    path = sinks.save_models(models, work_folder(spark, "models"), "seasonal")
    return sinks.load_models(spark, path).select("zipcode", "status", "n_rows", F.size("beta").alias("terms"))


def forecast_from_table(spark, folder, fit):
    train, _, _ = clean.split(cleaned(spark, folder))
    model, _ = fit(train)
    path = sinks.write_table(model.table(train), work_folder(spark, "global-model"))
    loaded = lag_regression.LagModel.from_table(spark.read.parquet(path))
    return lag_regression.forecast(loaded, train)


@query("s14_global_model")
def s14_global(spark, folder):
    return forecast_from_table(spark, folder, lag_regression.fit)


@query("s14_line_model", LINE_AHEAD, needs=["lag_line"], doubles=["yhat"], digits=5)
def s14_line(spark, folder):
    return forecast_from_table(spark, folder, fitted_line)


# --- whole jobs ----------------------------------------------------------------------


@query("h09_hotspot_job", """
    SELECT zipcode, cluster_id, CASE WHEN cluster_id = -1 OR disease_risk_score < 0.33 THEN 'Low' WHEN disease_risk_score < 0.66 THEN 'Medium' ELSE 'High' END AS risk_level,
           CASE WHEN cluster_id = -1 OR disease_risk_score < 0.33 THEN '#2ecc71' WHEN disease_risk_score < 0.66 THEN '#f39c12' ELSE '#e74c3c' END AS risk_color
    FROM summary JOIN region_clusters USING (zipcode)""", needs=["summary", "region_clusters"])
def h09(spark, folder):
    found = full_run.hotspot_job(featured(spark, folder), epsilon=WIDE, method="distance")
    return found.regions.select("zipcode", "cluster_id", "risk_level", "risk_color")


@query("h09_hotspot_job_hierarchy")
def h09_hierarchy(spark, folder):
    return full_run.hotspot_job(featured(spark, folder)).regions.select("zipcode", "cluster_id", "cluster_probability", "risk_level", "risk_color")


WRITTEN_AS = {"map": "text", "quality": "json", "evaluation": "json", "evaluation_summary": "json", "map_metadata": "json", "run_summary": "json"}


@query("e04_full_run", f"""
    SELECT 'features' AS name, count(*) AS n_rows FROM clean WHERE er_visits IS NOT NULL
    UNION ALL SELECT 'regions', count(*) FROM summary UNION ALL SELECT 'map', count(*) FROM summary WHERE lat IS NOT NULL AND lon IS NOT NULL
    UNION ALL SELECT 'forecast', count(*) + {P.FORECAST_HORIZON} * count(DISTINCT zipcode) FROM trained UNION ALL SELECT 'models', count(DISTINCT zipcode) FROM trained
    UNION ALL SELECT 'quality', count(*) FROM report UNION ALL SELECT 'evaluation', count(DISTINCT zipcode) + 1 FROM labelled WHERE split = 'test'
    UNION ALL SELECT 'evaluation_summary', 2 UNION ALL SELECT 'map_metadata', 1 UNION ALL SELECT 'run_summary', 1""",
       needs=["summary", "trained", "report"])
def e04(spark, folder):
    paths = full_run.full_run(
        derived.long_sources(spark, folder), derived.panel_regions(spark), work_folder(spark, "run"), unique=True
    )
    counts = [
        spark.read.format(WRITTEN_AS.get(name, "parquet")).load(path).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# --- streams ---------------------------------------------------------------------------


@query("x01_incremental_panel", """SELECT CAST(ts AS DATE) AS date, CAST(10000 + user_id % 15 AS VARCHAR) AS zipcode, count(*) AS n_events,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1, 2""", doubles=["total"])
def x01(spark, folder):
    return daily_panel.incremental_panel(spark, folder).withColumn("total", F.col("total").cast("double"))


@query("x02_stream_dedupe", "SELECT DISTINCT CAST(ts AS DATE) AS date, CAST(10000 + user_id % 15 AS VARCHAR) AS zipcode, event_type FROM events")
def x02(spark, folder):
    return daily_panel.deduplicated(spark, folder)


@query("x03_stateful_alerts", f"""SELECT *, {base.flag_sql('zscore')} AS alert FROM (SELECT zipcode, date, value, {base.zscore_sql('value')} AS zscore FROM (
    SELECT CAST(ts AS DATE) AS date, CAST(10000 + user_id % 15 AS VARCHAR) AS zipcode, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2) AS d) AS z""", doubles=["value", "zscore"])
def x03(spark, folder):
    events = derived.read(spark, folder, "events")
    daily = events.groupBy(F.to_date("ts").alias("date"), derived.region_key("user_id").alias("zipcode")).agg(F.count("*").alias("value"))
    return alerts.run_alerts(spark, daily)
