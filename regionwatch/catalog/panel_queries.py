"""Scans, projections, joins, cleaning and quality over the derived panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import windows
from ..operators import clean, lookup, merge, quality, region
from ..plans import jobs
from ..sources import derived, tables
from .base import (
    BLOCKS, NUMERIC, OTHERS, TIE_OFFSET, category_sql, clip_sql, cleaned, dec_sum, featured, fill_sql, key, lookup_values, merged, query,
)

ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz"
PICKED = ("10001", "10004", "10007")


@query("s01_scan", "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS date FROM orders")
def s01(spark, folder):
    rows = tables.scan(spark, f"{folder}/orders.parquet", ORDER_SCHEMA)
    return rows.withColumn("date", F.to_date("o_orderdate")).drop("o_orderdate")


@query("s02_range_filter", """
    SELECT * FROM pharmacy WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND zipcode IN ('10001', '10004', '10007')""",
       needs=["pharmacy"], doubles=["pharmacy_sales"])
def s02(spark, folder):
    return tables.in_range(derived.pharmacy(spark, folder), "1996-01-01", "1998-12-31", PICKED)


def source_counts(name: str, block: str, columns: int) -> str:
    return f"SELECT '{name}' AS source, count(*) AS n, {columns} AS n_columns, min(date) AS first_day, max(date) AS last_day FROM {block}"


@query("s03_collect_sources", " UNION ALL ".join([
    source_counts("pharmacy", "pharmacy", 4), source_counts("social_media", "social_media", 5),
    "SELECT 'weather', 0, 6, CAST(NULL AS DATE), CAST(NULL AS DATE)",
    source_counts("aqi", "air", 5), source_counts("er_visits", "er", 3)]),
       needs=["pharmacy", "social_media", "air", "er"])
def s03(spark, folder):
    given = {**derived.long_sources(spark, folder), "weather": None}
    parts = [
        df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.lit(len(df.columns)).alias("n_columns"),
               F.min("date").alias("first_day"), F.max("date").alias("last_day"))
        for name, df in tables.collect_sources(spark, given).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("p01_fix_types", """
    SELECT CAST(ts AS DATE) AS date, CAST(10000 + user_id % 15 AS VARCHAR) AS zipcode,
           CASE WHEN event_type = 'error' THEN NULL ELSE value END AS pharmacy_sales,
           CASE WHEN event_type = 'view' THEN NULL ELSE value END AS aqi, event_id FROM events""")
def p01(spark, folder):
    # landed text columns: one with words in place of numbers, one with NaN
    value = F.col("value").cast("string")
    raw = derived.read(spark, folder, "events").select(
        F.col("ts").cast("string").substr(1, 10).alias("date"),
        (F.lit(10000) + F.col("user_id") % 15).alias("zipcode"),
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(value).alias("pharmacy_sales"),
        F.when(F.col("event_type") == "view", F.lit("NaN")).otherwise(value).alias("aqi"),
        "event_id",
    )
    return clean.fix_types(raw)


@query("p02_cap_ranges", "SELECT date, zipcode, " + ", ".join(
    f"{clip_sql(c, *P.PHYSICAL_RANGES[c])} AS {c}" for c in ("aqi", "humidity_pct", "wind_speed_kmh", "pharmacy_sales"))
    + " FROM (SELECT * REPLACE (aqi * 10 AS aqi, humidity_pct * 2 AS humidity_pct, pharmacy_sales - 300 AS pharmacy_sales) FROM numbers) AS n",
    needs=["numbers"], doubles=["aqi", "humidity_pct", "wind_speed_kmh", "pharmacy_sales"])
def p02(spark, folder):
    raw = merged(spark, folder).withColumns(
        {"aqi": F.col("aqi") * 10, "humidity_pct": F.col("humidity_pct") * 2, "pharmacy_sales": F.col("pharmacy_sales") - 300}
    )
    return clean.cap_to_ranges(raw).select("date", "zipcode", "aqi", "humidity_pct", "wind_speed_kmh", "pharmacy_sales")


@query("p03_drop_missing_target", "SELECT date, zipcode, er_visits FROM merged WHERE er_visits IS NOT NULL", needs=["merged"])
def p03(spark, folder):
    return clean.drop_missing_target(merged(spark, folder)).select("date", "zipcode", "er_visits")


FEATURES = [c for c in (*NUMERIC, "lat", "lon") if c != P.TARGET]


@query("p04_feature_selection", f"SELECT date, zipcode, {', '.join(FEATURES)}, er_visits FROM clean",
       needs=["clean"], doubles=[*FEATURES, "er_visits"])
def p04(spark, folder):
    return clean.select_features(clean.flag_outliers(cleaned(spark, folder)))


PRUNED = [
    "pharmacy_sales", "negative_sentiment", "aqi", "temperature_c", "humidity_pct", "pharmacy_sales_roll_7_mean",
    "er_visits_lag_1", "er_visits_lag_7", "disease_risk_score",
]


@query("p05_priority_features", """
    SELECT date, zipcode, pharmacy_sales, negative_sentiment, aqi, temperature_c, humidity_pct, isodow(date) - 1 AS day_of_week,
           month(date) AS month, CAST(floor((month(date) % 12) / 3) + 1 AS BIGINT) AS season,
           CASE WHEN isodow(date) > 5 THEN 1 ELSE 0 END AS is_weekend,
           avg(pharmacy_sales) OVER (PARTITION BY zipcode ORDER BY date ROWS 6 PRECEDING) AS pharmacy_sales_roll_7_mean,
           lag(er_visits, 1) OVER (PARTITION BY zipcode ORDER BY date) AS er_visits_lag_1,
           lag(er_visits, 7) OVER (PARTITION BY zipcode ORDER BY date) AS er_visits_lag_7, disease_risk_score
    FROM scored""", needs=["scored"], doubles=PRUNED)
def p05(spark, folder):
    return clean.priority_features(featured(spark, folder))


@query("p06_region_series", """
    SELECT date, zipcode, er_visits FROM clean WHERE zipcode = '10003' AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' ORDER BY date""",
       needs=["clean"], doubles=["er_visits"])
def p06(spark, folder):
    return region.region_series(cleaned(spark, folder).select("date", "zipcode", "er_visits"), "10003", "1997-01-01", "1999-12-31")


@query("p11_sorted_keys", f"SELECT DISTINCT {key('o_custkey')} AS zipcode FROM orders ORDER BY 1")
def p11(spark, folder):
    rows = derived.read(spark, folder, "orders").select(derived.region_key("o_custkey").alias("zipcode"))
    return region.region_keys(rows)


@query("p13_distinct_by_weekday", """
    SELECT date, day_of_week, dow_sin, dow_cos FROM (
        SELECT date, isodow(date) - 1 AS day_of_week, sin(2 * pi() * (isodow(date) - 1) / 7) AS dow_sin,
               cos(2 * pi() * (isodow(date) - 1) / 7) AS dow_cos,
               row_number() OVER (PARTITION BY isodow(date) ORDER BY date) AS k FROM (SELECT DISTINCT date FROM clean) AS d) AS x
    WHERE k = 1 ORDER BY day_of_week""", needs=["clean"], doubles=["dow_sin", "dow_cos"])
def p13(spark, folder):
    from ..functions.calendar import calendar_columns

    calendar = calendar_columns()
    rows = cleaned(spark, folder).select("date", *[calendar[c].alias(c) for c in ("day_of_week", "dow_sin", "dow_cos")])
    return quality.distinct_by(rows, "day_of_week", ["date"])


@query("p14_signals_long", " UNION ALL ".join(
    f"SELECT zipcode, date, '{s}' AS signal, {s} AS value FROM clean WHERE zipcode = '10005'" for s in region.SIGNALS),
    needs=["clean"], doubles=["value"])
def p14(spark, folder):
    return region.signals_long(cleaned(spark, folder), "10005")


# --- joins ---------------------------------------------------------------------

MERGED_COLUMNS = ["pharmacy_sales", "negative_sentiment", "symptom_mention_rate", "temperature_c", "humidity_pct",
                  "precipitation_mm", "wind_speed_kmh", "aqi", "pm25_ugm3"]


@query("j01_outer_merge", "SELECT * EXCLUDE (city, state, lat, lon) FROM merged", needs=["merged"], doubles=MERGED_COLUMNS)
def j01(spark, folder):
    return merge.outer_merge(derived.long_sources(spark, folder), unique=True)


@query("j01_outer_merge_events", """
    SELECT * FROM (SELECT CAST(ts AS DATE) AS date, CAST(10000 + user_id % 15 AS VARCHAR) AS zipcode,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS pharmacy_sales FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) AS a
    FULL JOIN (SELECT CAST(ts AS DATE) AS date, CAST(10000 + user_id % 15 AS VARCHAR) AS zipcode, count(*) AS post_volume
        FROM events WHERE event_type = 'view' GROUP BY 1, 2) AS b USING (date, zipcode)
    FULL JOIN (SELECT CAST(ts AS DATE) AS date, CAST(10000 + user_id % 15 AS VARCHAR) AS zipcode,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS aqi FROM events WHERE event_type = 'click' GROUP BY 1, 2) AS c USING (date, zipcode)
    FULL JOIN (SELECT CAST(ts AS DATE) AS date, CAST(10000 + user_id % 15 AS VARCHAR) AS zipcode, count(*) AS er_visits
        FROM events WHERE event_type = 'signup' GROUP BY 1, 2) AS d USING (date, zipcode)""", doubles=["pharmacy_sales", "aqi"])
def j01_events(spark, folder):
    return merge.outer_merge(derived.event_sources(derived.read(spark, folder, "events")), unique=True)


@query("j02_inner_chain", """
    SELECT date, zipcode, pharmacy_sales, negative_sentiment, post_volume, temperature_c, aqi, aqi_category, er_visits
    FROM pharmacy JOIN social_media USING (date, zipcode) JOIN weather USING (date, zipcode) JOIN air USING (date, zipcode) JOIN er USING (date, zipcode)""",
       needs=["pharmacy", "social_media", "weather", "air", "er"], doubles=["pharmacy_sales", "negative_sentiment", "temperature_c", "aqi"])
def j02(spark, folder):
    joined = merge.inner_merge(list(derived.long_sources(spark, folder).values()))
    return joined.select("date", "zipcode", "pharmacy_sales", "negative_sentiment", "post_volume", "temperature_c", "aqi", "aqi_category", "er_visits")


@query("j03_region_join", "SELECT date, zipcode, er_visits, city, state, lat, lon FROM er LEFT JOIN regions USING (zipcode)", needs=["er", "regions"])
def j03(spark, folder):
    return merge.attach_regions(derived.er_visits(spark, folder), derived.panel_regions(spark))


# customers spread over the known keys, an unknown one, and keys only the landed table knows
KNOWN = [r[0] for r in P.STATIC_LOOKUP]
SPREAD = len(KNOWN) + 2
LANDED_SQL = """SELECT '99901' AS zipcode, min(s_name) AS city, 'ZZ' AS state, CAST(min(s_suppkey) AS DOUBLE) AS lat, CAST(max(s_suppkey) AS DOUBLE) AS lon FROM supplier
    UNION ALL SELECT '98101', 'Elsewhere', 'ZZ', 0.0::DOUBLE, 0.0::DOUBLE"""
KEYED_SQL = "SELECT c_custkey, CASE c_custkey % %d %s ELSE '99999' END AS zipcode FROM customer" .replace("% %d", f"% {SPREAD}").replace(
    "%s", " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate([*KNOWN, "99901"])))
CHAIN_SQL = f"""
    SELECT c.c_custkey, c.zipcode, coalesce(a.lat, b.lat, d.lat) AS lat, coalesce(a.lon, b.lon, d.lon) AS lon,
           coalesce(a.city, b.city, d.city, '') AS city, coalesce(a.state, b.state, d.state, '') AS state
    FROM ({KEYED_SQL}) AS c LEFT JOIN ({lookup_values(P.REGIONS)}) AS a USING (zipcode)
    LEFT JOIN ({lookup_values(P.STATIC_LOOKUP)}) AS b USING (zipcode) LEFT JOIN ({LANDED_SQL}) AS d USING (zipcode)"""


def keyed_customers(spark, folder):
    keys = F.array(*[F.lit(z) for z in [*KNOWN, "99901", "99999"]])
    return derived.read(spark, folder, "customer").select(
        "c_custkey", F.element_at(keys, (F.col("c_custkey") % SPREAD + 1).cast("int")).alias("zipcode")
    )


def providers(spark, folder):
    supplier = derived.read(spark, folder, "supplier")
    landed = supplier.agg(
        F.min("s_name").alias("city"), F.lit("ZZ").alias("state"),
        F.min("s_suppkey").cast("double").alias("lat"), F.max("s_suppkey").cast("double").alias("lon"),
    ).withColumn("zipcode", F.lit("99901"))
    late = merge.region_table(spark, [("98101", "Elsewhere", "ZZ", 0.0, 0.0)])
    return [merge.region_table(spark), merge.region_table(spark, P.STATIC_LOOKUP), landed.unionByName(late)]


@query("j04_lookup_chain", CHAIN_SQL)
def j04(spark, folder):
    return lookup.geocode(keyed_customers(spark, folder), providers(spark, folder)).select(
        "c_custkey", "zipcode", "lat", "lon", "city", "state"
    )


@query("j05_lookup_default", f"""
    SELECT c_custkey, zipcode, coalesce(risk_level, 'Low') AS risk_level FROM (SELECT c_custkey, {key('c_custkey')} AS zipcode FROM customer) AS c
    LEFT JOIN (SELECT zipcode, risk_level FROM levels WHERE risk_level <> 'Low') AS l USING (zipcode)""", needs=["levels"])
def j05(spark, folder):
    summary = region.map_summary(featured(spark, folder))
    levels = region.filter_levels(summary, ["High", "Medium"])
    rows = derived.read(spark, folder, "customer").select("c_custkey", derived.region_key("c_custkey").alias("zipcode"))
    return merge.lookup_with_default(rows, levels, "zipcode", "risk_level", "Low").select("c_custkey", "zipcode", "risk_level")


@query("j06_interval_membership", f"""
    SELECT p.date, p.zipcode, p.pharmacy_sales, EXISTS (
        SELECT 1 FROM orders AS o WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 AND {key('o_custkey')} = p.zipcode
        AND p.date BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 6) AS outbreak_event
    FROM pharmacy AS p""", needs=["pharmacy"], doubles=["pharmacy_sales"])
def j06(spark, folder):
    start = F.to_date("o_orderdate")
    intervals = (
        derived.read(spark, folder, "orders")
        .filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000))
        .select(derived.region_key("o_custkey").alias("zipcode"), start.alias("start"), F.date_add(start, 6).alias("end"))
    )
    panel = derived.pharmacy(spark, folder).drop("outbreak_event")
    return merge.in_any_interval(panel, intervals, "outbreak_event").select("date", "zipcode", "pharmacy_sales", "outbreak_event")


@query("j07_days_by_regions", """
    SELECT date, post_volume, zipcode FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS post_volume FROM events GROUP BY 1) AS d
    CROSS JOIN (VALUES ('10001'), ('10004'), ('10007')) AS z(zipcode)""")
def j07(spark, folder):
    daily = derived.read(spark, folder, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("post_volume"))
    return merge.copy_to_regions(daily, PICKED)


@query("j09_unmatched", f"SELECT count(*) AS n_unmatched FROM ({CHAIN_SQL}) AS c WHERE lat IS NULL")
def j09(spark, folder):
    return lookup.unresolved(keyed_customers(spark, folder), providers(spark, folder)).agg(F.count("*").alias("n_unmatched"))


# --- cleaning ------------------------------------------------------------------


@query("q01_deduplicate", f"""
    SELECT date, zipcode, o_orderkey, o_totalprice FROM (
        SELECT CAST(o_orderdate AS DATE) AS date, {key('o_custkey')} AS zipcode, o_orderkey, o_totalprice,
               row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), {key('o_custkey')} ORDER BY o_orderkey) AS k FROM orders) AS x
    WHERE k = 1""")
def q01(spark, folder):
    rows = derived.read(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("date"), derived.region_key("o_custkey").alias("zipcode"), "o_orderkey", "o_totalprice"
    )
    return merge.keep_first(rows, P.KEYS, ["o_orderkey"])


@query("q02_fill_within_region", f"SELECT date, zipcode, {', '.join(NUMERIC)} FROM filled", needs=["filled"], doubles=NUMERIC)
def q02(spark, folder):
    return windows.fill_within_region(merged(spark, folder), NUMERIC).select("date", "zipcode", *NUMERIC)


HOLED_SQL = "SELECT * REPLACE (CASE WHEN zipcode <> '10003' THEN aqi END AS aqi, CASE WHEN zipcode <> '10008' THEN pharmacy_sales END AS pharmacy_sales) FROM filled"


@query("q03_median_fallback", f"""
    SELECT date, zipcode, coalesce(aqi, (SELECT quantile_cont(aqi, 0.5) FROM ({HOLED_SQL}) AS a)) AS aqi,
           coalesce(pharmacy_sales, (SELECT quantile_cont(pharmacy_sales, 0.5) FROM ({HOLED_SQL}) AS b)) AS pharmacy_sales
    FROM ({HOLED_SQL}) AS h""", needs=["filled"], doubles=["aqi", "pharmacy_sales"])
def q03(spark, folder):
    # two regions lose one source each, so the fill within the region leaves gaps
    holed = merged(spark, folder).withColumns(
        {
            "aqi": F.when(F.col("zipcode") != "10003", F.col("aqi")),
            "pharmacy_sales": F.when(F.col("zipcode") != "10008", F.col("pharmacy_sales")),
        }
    )
    return clean.impute(holed, ["aqi", "pharmacy_sales"]).select("date", "zipcode", "aqi", "pharmacy_sales")


@query("q04_mean_imputation", """
    SELECT date, zipcode, CAST(CAST(coalesce(pharmacy_sales, avg(pharmacy_sales) OVER ()) AS FLOAT) AS DOUBLE) AS pharmacy_sales,
           CAST(CAST(coalesce(er_visits, avg(er_visits) OVER ()) AS FLOAT) AS DOUBLE) AS er_visits FROM numbers""",
       needs=["numbers"], doubles=["pharmacy_sales", "er_visits"], digits=3)
def q04(spark, folder):
    return clean.fill_with_mean(merged(spark, folder), ["pharmacy_sales", "er_visits"]).select("date", "zipcode", "pharmacy_sales", "er_visits")


def outlier_sql(c: str) -> str:
    w = "OVER (PARTITION BY zipcode)"
    return (f"coalesce(CASE WHEN max({c}) {w} > min({c}) {w} THEN abs(({c} - avg({c}) {w}) / stddev_pop({c}) {w}) > 2.5 END, false) AS {c}_outlier")


OUTLIERS = ", ".join(outlier_sql(c) for c in P.ANOMALY_COLUMNS)
BLOCKS["outliers"] = (("clean",), f"SELECT *, {OUTLIERS} FROM clean")


@query("q05_outlier_flags", f"SELECT date, zipcode, {', '.join(c + '_outlier' for c in P.ANOMALY_COLUMNS)} FROM outliers", needs=["outliers"])
def q05(spark, folder):
    return clean.flag_outliers(cleaned(spark, folder)).select("date", "zipcode", *[f"{c}_outlier" for c in P.ANOMALY_COLUMNS])


def winsor_sql(c: str) -> str:
    return f"greatest(least({c}, (SELECT quantile_cont({c}, 0.99) FROM clean)), (SELECT quantile_cont({c}, 0.01) FROM clean)) AS {c}"


@query("q06_winsorise", f"SELECT date, zipcode, {winsor_sql('pharmacy_sales')}, {winsor_sql('aqi')} FROM clean", needs=["clean"], doubles=["pharmacy_sales", "aqi"])
def q06(spark, folder):
    return clean.winsorise(cleaned(spark, folder), ["pharmacy_sales", "aqi"]).select("date", "zipcode", "pharmacy_sales", "aqi")


# --- quality -------------------------------------------------------------------


@query("q07_overview", "SELECT count(*) AS n_rows, 23 AS n_cols, count(DISTINCT zipcode) AS n_regions, min(date) AS start, max(date) AS \"end\" FROM clean", needs=["clean"])
def q07(spark, folder):
    return quality.overview(clean.flag_outliers(cleaned(spark, folder)))


COUNTED = [*NUMERIC, "outbreak_event", "aqi_category", "city", "state", "lat", "lon", "date", "zipcode"]
MISSING_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_, count(*) - count({c}) AS count_, count(*) AS n FROM merged" for c in COUNTED)


@query("q08_missing_values", f"""SELECT column_ AS "column", count_ AS "count", round(count_ * 100.0::DOUBLE / n, 2) AS pct FROM ({MISSING_SQL}) AS m WHERE count_ > 0""", needs=["merged"])
def q08(spark, folder):
    return quality.missing_values(merged(spark, folder))


@query("q09_outlier_counts", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c}_outlier) AS "count" FROM outliers""" for c in P.ANOMALY_COLUMNS), needs=["outliers"])
def q09(spark, folder):
    return quality.outlier_counts(clean.flag_outliers(cleaned(spark, folder)))


STAT_COLUMNS = [*NUMERIC, "lat", "lon"]


@query("q10_numeric_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}) + 3.1e-10, 4) AS mean, round(stddev_samp({c}) + 3.1e-10, 4) AS std, round(min({c}) + 3.1e-10, 4) AS min,
        round(max({c}) + 3.1e-10, 4) AS max, round(quantile_cont({c}, 0.5) + 3.1e-10, 4) AS p50 FROM clean""" for c in STAT_COLUMNS), needs=["clean"])
def q10(spark, folder):
    return quality.numeric_stats(cleaned(spark, folder), STAT_COLUMNS)


def dataset_sql(name: str, block: str, columns: list[str]) -> str:
    share = " + ".join(f"CAST(count(*) - count({c}) AS DOUBLE) / count(*)" for c in columns)
    return (f"""SELECT '{name}' AS dataset, count(*) AS rows, {len(columns)} AS columns, count(DISTINCT zipcode) AS zip_codes,
        min(date) AS start, max(date) AS "end", round(({share}) / {len(columns)} * 100, 2) AS missing_pct FROM {block}""")


@query("q11_datasets_table", " UNION ALL ".join([
    dataset_sql("pharmacy", "pharmacy", ["date", "zipcode", "pharmacy_sales", "outbreak_event"]),
    dataset_sql("social_media", "social_media", ["date", "zipcode", "negative_sentiment", "post_volume", "symptom_mention_rate"]),
    dataset_sql("weather", "weather", ["date", "zipcode", "temperature_c", "humidity_pct", "precipitation_mm", "wind_speed_kmh"]),
    dataset_sql("aqi", "air", ["date", "zipcode", "aqi", "pm25_ugm3", "aqi_category"]),
    dataset_sql("er_visits", "er", ["date", "zipcode", "er_visits"]),
    dataset_sql("master", "merged", ["date", "zipcode", *NUMERIC, "outbreak_event", "aqi_category", "city", "state", "lat", "lon"])]),
       needs=["merged"])
def q11(spark, folder):
    return quality.datasets_table({**derived.long_sources(spark, folder), "master": merged(spark, folder)})


def describe_sql(c: str, number: bool) -> str:
    stats = (f"avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
             f"quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75") if number else \
        "NULL AS mean, NULL AS std, NULL AS min, NULL AS max, NULL AS p25, NULL AS p50, NULL AS p75"
    top = f"FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM numbers WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k DESC, v DESC LIMIT 1) AS t)"
    return (f"""SELECT '{c}' AS "column", count({c}) AS "count", count(DISTINCT {c}) AS "unique",
        (SELECT v {top} AS top, (SELECT k {top} AS freq, {stats} FROM numbers""")


DESCRIBED = {**dict.fromkeys([*NUMERIC, "lat", "lon"], True), **dict.fromkeys(["outbreak_event", "aqi_category", "city", "state", "zipcode", "date"], False)}


@query("q12_describe", " UNION ALL ".join(describe_sql(c, n) for c, n in DESCRIBED.items()),
       needs=["numbers"], doubles=["mean", "std", "min", "max", "p25", "p50", "p75"], digits=4)
def q12(spark, folder):
    return quality.describe(clean.fix_types(merged(spark, folder)))


@query("q13_missing_counts", f"""SELECT column_ AS "column", count_ AS "count" FROM ({MISSING_SQL}) AS m WHERE count_ > 0""", needs=["merged"])
def q13(spark, folder):
    return quality.missing_values(merged(spark, folder)).drop("pct")


@query("q14_temporal_split", "SELECT split, count(*) AS n, min(date) AS first_day, max(date) AS last_day, count(DISTINCT date) AS n_days FROM labelled GROUP BY split", needs=["labelled"])
def q14(spark, folder):
    return clean.label_split(cleaned(spark, folder)).groupBy("split").agg(
        F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count_distinct("date").alias("n_days")
    )


@query("q15_dataset_summary", " UNION ALL ".join(
    f"""SELECT count(DISTINCT zipcode) AS n_regions, min(date) AS start, max(date) AS "end", count(*) AS n_rows, '{c}' AS "column",
        avg({c}) AS mean, stddev_samp({c}) AS std, max({c}) AS max FROM clean""" for c in quality.SUMMARY_COLUMNS), needs=["clean"], doubles=["mean", "std", "max"])
def q15(spark, folder):
    return quality.dataset_summary(cleaned(spark, folder))


# --- cleaning and preprocess jobs ----------------------------------------------


@query("e01_clean", "SELECT * FROM clean", needs=["clean"], doubles=[*NUMERIC, "lat", "lon"])
def e01(spark, folder):
    return cleaned(spark, folder)


@query("e02_preprocess", f"""
    SELECT date, zipcode, {', '.join(NUMERIC)}, {', '.join(c + '_outlier' for c in P.ANOMALY_COLUMNS)},
           CASE WHEN date < c1 THEN 'train' WHEN date < c2 THEN 'validation' ELSE 'test' END AS split FROM outliers, cuts""",
       needs=["outliers", "cuts"], doubles=NUMERIC)
def e02(spark, folder):
    job = jobs.preprocess(derived.long_sources(spark, folder), derived.panel_regions(spark), unique=True)
    flags = [f"{c}_outlier" for c in P.ANOMALY_COLUMNS]
    parts = [df.select("date", "zipcode", *NUMERIC, *flags).withColumn("split", F.lit(name))
             for name, df in zip(clean.SPLITS, (job.train, job.validation, job.test))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stat_sql(c: str) -> str:
    stats = (f"avg({c})", f"stddev_samp({c})", f"min({c})", f"max({c})", f"quantile_cont({c}, 0.5)")
    return f"SELECT '{c}' AS c, [{', '.join(f'round({s} + {TIE_OFFSET}, 4)' for s in stats)}] AS stats FROM outliers"


BLOCKS["report"] = (("outliers",), f"""
    SELECT section, "column", metric, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS text, try_cast(value AS DOUBLE) AS number FROM (
    SELECT 'overview' AS section, CAST(NULL AS VARCHAR) AS "column", metric, value FROM (
        SELECT unnest(['n_rows', 'n_cols', 'n_regions', 'start', 'end']) AS metric,
               unnest([CAST(count(*) AS VARCHAR), '23', CAST(count(DISTINCT zipcode) AS VARCHAR), CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR)]) AS value
        FROM outliers) AS o
    UNION ALL SELECT 'outlier_counts', c, 'count', CAST(n AS VARCHAR) FROM ({' UNION ALL '.join(
        f"SELECT '{c}' AS c, count(*) FILTER ({c}_outlier) AS n FROM outliers" for c in P.ANOMALY_COLUMNS)}) AS x
    UNION ALL SELECT 'missing_values', c, unnest(['count', 'pct']), unnest([CAST(n AS VARCHAR), CAST(round(n * 100.0::DOUBLE / total, 2) AS VARCHAR)])
        FROM ({' UNION ALL '.join(f"SELECT '{c}' AS c, count(*) - count({c}) AS n, count(*) AS total FROM outliers" for c in COUNTED)}) AS y WHERE n > 0) AS r
    UNION ALL SELECT 'numeric_stats', c, unnest(['mean', 'std', 'min', 'max', 'p50']), NULL, unnest(stats) FROM ({' UNION ALL '.join(stat_sql(c) for c in STAT_COLUMNS)}) AS z""")


def values_apart(report):
    """Numbers as numbers, since engines write them differently."""
    number = F.col("value").try_cast("double")
    return report.select("section", "column", "metric", F.when(number.isNull(), F.col("value")).alias("text"), number.alias("number"))


@query("e02_quality_report", "SELECT * FROM report", needs=["report"], doubles=["number"])
def e02_report(spark, folder):
    job = jobs.preprocess(derived.long_sources(spark, folder), derived.panel_regions(spark), unique=True)
    return values_apart(job.report)
