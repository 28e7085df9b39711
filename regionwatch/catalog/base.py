"""Registration of named queries with their SQL twins, and shared SQL building blocks.

A query is a Spark function of (session, data folder). Where plain SQL can say the
same, the twin is a DuckDB statement over the same tables, built from the common
table expressions below. Doubles are compared after rounding; both sides add the
same tiny offset first so that exact decimal ties round alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from .. import params as P
from ..plans.jobs import clean_panel, feature_job
from ..session import reuse
from ..sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TIE_OFFSET = 3.1e-10


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as bigint: the form in which results are compared."""
    out = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = f"round(double({c}) + {TIE_OFFSET!r}D, {digits}) AS {c}"
        elif isinstance(f.dataType, T.IntegralType):
            c = f"bigint({c}) AS {c}"
        out.append(c)
    return df.selectExpr(*out)


def query(
    name: str, sql: str | None = None, needs: Sequence[str] = (), doubles: Sequence[str] = (), digits: int = 6
):
    """Register a Spark query; ``sql`` is the twin's body, ``needs`` its building blocks
    and ``doubles`` the columns to round."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: tidy(fn(spark, folder), digits)
        if sql is not None:
            ORACLES[name] = with_blocks(rounded(sql, doubles, digits), needs)
        return fn

    return register


def rounded(sql: str, doubles: Sequence[str], digits: int = 6) -> str:
    if not doubles:
        return sql
    items = ", ".join(f"round({c} + {TIE_OFFSET}, {digits}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({items}) FROM ({sql}) AS answer"


def with_blocks(sql: str, needs: Sequence[str]) -> str:
    names: list[str] = []

    def add(name: str) -> None:
        for dep in BLOCKS[name][0]:
            add(dep)
        if name not in names:
            names.append(name)

    for n in needs:
        add(n)
    if not names:
        return sql
    blocks = ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in names)
    return f"WITH {blocks}\n{sql}"


# --- shared Spark frames ------------------------------------------------------


def merged(spark: SparkSession, folder: str) -> DataFrame:
    return reuse(derived.long_panel(spark, folder))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return reuse(clean_panel(derived.long_panel(spark, folder)))


def featured(spark: SparkSession, folder: str) -> DataFrame:
    return feature_job(cleaned(spark, folder))


# --- shared SQL blocks: name -> (needed blocks, body) -------------------------

NUMERIC = P.NUMERIC_COLUMNS


def key(column: str) -> str:
    return f"CAST(10000 + {column} % {derived.REGION_COUNT} AS VARCHAR)"


def dec_sum(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


def clip_sql(column: str, low, high) -> str:
    inner = column
    if low is not None:
        inner = f"greatest({inner}, {low})"
    if high is not None:
        inner = f"least({inner}, {high})"
    return f"CASE WHEN {column} IS NOT NULL THEN {inner} END"


def category_sql(column: str) -> str:
    cases = " ".join(f"WHEN {column} <= {hi} THEN '{label}'" for hi, label in P.AQI_CATEGORIES)
    return f"CASE WHEN {column} IS NULL THEN NULL {cases} ELSE 'Hazardous' END"


def region_values() -> str:
    rows = ", ".join(
        f"('{10000 + i}', '{city}', '{state}', {lat}, {lon})" for i, (_, city, state, lat, lon) in enumerate(P.REGIONS)
    )
    return f"SELECT zipcode, city, state, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM (VALUES {rows}) AS v(zipcode, city, state, lat, lon)"


def lookup_values(rows) -> str:
    body = ", ".join(f"('{z}', '{c}', '{s}', {lat}, {lon})" for z, c, s, lat, lon in rows)
    return f"SELECT zipcode, city, state, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM (VALUES {body}) AS v(zipcode, city, state, lat, lon)"


BY_DATE = "PARTITION BY zipcode ORDER BY date"


def frame(rows: int) -> str:
    return f"OVER ({BY_DATE} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def lag_sql(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER ({BY_DATE})"


def rolling_sql(c: str, n: int, stat: str) -> str:
    w = frame(n)
    return {
        "mean": f"avg({c}) {w}",
        "std": f"coalesce(stddev_samp({c}) {w}, 0)",
        "max": f"max({c}) {w}",
        "min": f"min({c}) {w}",
        "sum": f"sum({c}) {w}",
    }[stat]


def change_sql(x: str, p: str) -> str:
    return (
        f"CASE WHEN {p} = 0 THEN CASE WHEN {x} > 0 THEN 5.0 WHEN {x} < 0 THEN -5.0 ELSE 0.0 END "
        f"WHEN {x} IS NULL OR {p} IS NULL THEN 0.0 ELSE greatest(least({x} / {p} - 1, 5.0), -5.0) END"
    )


def zscore_sql(c: str, n: int = 30, k: int = 5, eps: float = 1e-8) -> str:
    w = frame(n)
    return (
        f"coalesce(CASE WHEN count({c}) {w} >= {k} AND max({c}) {w} > min({c}) {w} "
        f"THEN ({c} - avg({c}) {w}) / (stddev_samp({c}) {w} + {eps}) END, 0.0)"
    )


def flag_sql(z: str, t: float = 2.5) -> str:
    return f"CASE WHEN abs({z}) > {t} THEN 1 ELSE 0 END"


RUNNING = f"OVER ({BY_DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = f"OVER ({BY_DATE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
OTHERS = "outbreak_event, aqi_category, city, state, lat, lon"


def fill_sql(columns: Sequence[str], source: str, others: str) -> str:
    forward = ", ".join(f"last_value({c} IGNORE NULLS) {RUNNING} AS {c}" for c in columns)
    back = ", ".join(f"coalesce({c}, first_value({c} IGNORE NULLS) {AHEAD}) AS {c}" for c in columns)
    head = "date, zipcode" + (f", {others}" if others else "")
    return f"SELECT {head}, {back} FROM (SELECT {head}, {forward} FROM {source}) AS f"


def minmax_sql(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} = {lo} THEN 0.0 ELSE ({x} - {lo}) / ({hi} - {lo}) END)"


CALENDAR_SQL = {
    "day_of_week": "isodow(date) - 1",
    "day_of_year": "dayofyear(date)",
    "month": "month(date)",
    "week_of_year": "weekofyear(date)",
    "year": "year(date)",
    "quarter": "quarter(date)",
    "is_weekend": "CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END",
    "season": "CASE WHEN month(date) IN (12, 1, 2) THEN 1 WHEN month(date) <= 5 THEN 2 WHEN month(date) <= 8 THEN 3 ELSE 4 END",
    "dow_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)",
    "dow_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)",
    "month_sin": "sin(2 * pi() * month(date) / 12)",
    "month_cos": "cos(2 * pi() * month(date) / 12)",
}
HEAT_SQL = "temperature_c + 0.33 * (humidity_pct / 100 * 6.105 * exp(17.27 * temperature_c / (237.7 + temperature_c))) - 4"

ZSCORES = ", ".join(f"{zscore_sql(c)} AS {c}_zscore" for c in P.ANOMALY_COLUMNS)
FLAGS = ", ".join(f"{flag_sql(c + '_zscore')} AS {c}_anomaly" for c in P.ANOMALY_COLUMNS)
FLAG_SUM = "(" + " + ".join(f"{c}_anomaly" for c in P.ANOMALY_COLUMNS) + ")"
SCORE_PARTS = {
    "pharmacy_sales": "pharmacy_sales",
    "negative_sentiment": "negative_sentiment",
    "aqi": "aqi",
    "temp_extreme": "abs(temperature_c - 18)",
    "anomaly_count": FLAG_SUM,
}


def score_sql() -> str:
    terms = " + ".join(
        f"{P.SCORE_WEIGHTS[n]} * " + minmax_sql(x, f"lo_{n}", f"hi_{n}") for n, x in SCORE_PARTS.items()
    )
    return f"greatest(least(({terms}) / {sum(P.SCORE_WEIGHTS.values())}, 1.0), 0.0)"


BOUNDS = ", ".join(f"min({x}) AS lo_{n}, max({x}) AS hi_{n}" for n, x in SCORE_PARTS.items())

BLOCKS: dict[str, tuple[Sequence[str], str]] = {
    "pharmacy": ((), f"""
        SELECT CAST(o_orderdate AS DATE) AS date, {key('o_custkey')} AS zipcode,
               {dec_sum('o_totalprice')} / 1000 AS pharmacy_sales, bool_or(o_orderpriority = '1-URGENT') AS outbreak_event
        FROM orders GROUP BY 1, 2"""),
    "social_media": ((), f"""
        SELECT CAST(l_shipdate AS DATE) AS date, {key('l_suppkey')} AS zipcode,
               CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS negative_sentiment,
               count(*) AS post_volume,
               CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) / count(*) AS symptom_mention_rate
        FROM lineitem GROUP BY 1, 2"""),
    "weather": ((), f"""
        SELECT CAST(l_shipdate AS DATE) AS date, {key('l_partkey')} AS zipcode,
               {dec_sum('l_quantity')} / count(l_quantity) - 8 AS temperature_c,
               {dec_sum('l_tax')} / count(l_tax) * 1000 AS humidity_pct,
               max(l_discount) * 100 AS precipitation_mm,
               CAST(sum(l_linenumber) AS DOUBLE) / count(*) * 5 AS wind_speed_kmh
        FROM lineitem GROUP BY 1, 2"""),
    "air": ((), f"""
        SELECT *, {category_sql('aqi')} AS aqi_category FROM (
        SELECT CAST(l_shipdate AS DATE) AS date, {key('l_orderkey')} AS zipcode,
               {dec_sum('l_extendedprice')} / count(l_extendedprice) / 500 AS aqi,
               {dec_sum('l_extendedprice')} / count(l_extendedprice) / 1250 AS pm25_ugm3
        FROM lineitem GROUP BY 1, 2) AS a"""),
    "er": ((), f"""
        SELECT CAST(o_orderdate AS DATE) AS date, {key('o_orderkey')} AS zipcode,
               count(*) * 10 + 5 * count(*) FILTER (o_orderstatus = 'F') AS er_visits
        FROM orders GROUP BY 1, 2"""),
    "regions": ((), region_values()),
    "merged": (("pharmacy", "social_media", "weather", "air", "er", "regions"), """
        SELECT m.*, r.city, r.state, r.lat, r.lon FROM (
            SELECT * FROM pharmacy FULL JOIN social_media USING (date, zipcode) FULL JOIN weather USING (date, zipcode)
            FULL JOIN air USING (date, zipcode) FULL JOIN er USING (date, zipcode)) AS m
        LEFT JOIN regions AS r ON r.zipcode = m.zipcode"""),
    "numbers": (("merged",), "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC) + ") FROM merged"),
    "filled": (("numbers",), fill_sql(NUMERIC, "numbers", OTHERS)),
    "medians": (("filled",), "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in NUMERIC) + " FROM filled"),
    "imputed": (("filled", "medians"),
                f"SELECT date, zipcode, {OTHERS}, " + ", ".join(f"coalesce({c}, med_{c}) AS {c}" for c in NUMERIC) + " FROM filled, medians"),
    "clean": (("imputed",), "SELECT * REPLACE (" + ", ".join(
        f"{clip_sql(c, lo, hi)} AS {c}" for c, (lo, hi) in P.PHYSICAL_RANGES.items()) + ") FROM imputed"),
    "zscored": (("clean",), f"SELECT *, {ZSCORES} FROM clean"),
    "flagged": (("zscored",), f"SELECT *, {FLAGS} FROM zscored"),
    "bounds": (("flagged",), f"SELECT {BOUNDS} FROM flagged"),
    "scored": (("flagged", "bounds"), f"SELECT flagged.*, {score_sql()} AS disease_risk_score FROM flagged, bounds"),
    "last_day": (("clean",), "SELECT max(date) AS last FROM clean"),
    "recent30": (("scored", "last_day"), "SELECT scored.* FROM scored, last_day WHERE date >= last - 30"),
    "summary": (("recent30",), """
        SELECT zipcode, avg(er_visits) AS er_visits, avg(pharmacy_sales) AS pharmacy_sales,
               avg(negative_sentiment) AS negative_sentiment, avg(aqi) AS aqi, avg(disease_risk_score) AS disease_risk_score,
               min(lat) AS lat, min(lon) AS lon, min(city) AS city, min(state) AS state
        FROM recent30 GROUP BY zipcode"""),
    "levels": (("summary",), """
        SELECT *, CASE WHEN disease_risk_score > 0.66 THEN 'High' WHEN disease_risk_score > 0.33 THEN 'Medium' ELSE 'Low' END AS risk_level
        FROM summary"""),
    "split_days": (("clean",), """
        SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM clean) AS d"""),
    "cuts": (("split_days",), """
        SELECT min(date) FILTER (pos = floor(n * 0.7::DOUBLE)) AS c1, min(date) FILTER (pos = floor(n * (0.7::DOUBLE + 0.15::DOUBLE))) AS c2 FROM split_days"""),
    "labelled": (("clean", "cuts"), """
        SELECT clean.*, CASE WHEN date < c1 THEN 'train' WHEN date < c2 THEN 'validation' ELSE 'test' END AS split FROM clean, cuts"""),
}
