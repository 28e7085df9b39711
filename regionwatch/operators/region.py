"""Region snapshots, rankings, pivots and dashboard tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import params as P
from ..functions.guards import earliest, numeric_columns, one_row, present
from ..functions.scores import risk_level_exclusive
from .merge import lookup_with_default

SNAPSHOT_MEANS = (
    "pharmacy_sales", "negative_sentiment", "aqi", "temperature_c", "er_visits", "disease_risk_score",
)
SNAPSHOT_SUMS = ("pharmacy_sales_anomaly", "er_visits_anomaly", "negative_sentiment_anomaly")
SNAPSHOT_FIRSTS = ("lat", "lon", "city", "state")
MAP_MEANS = ("er_visits", "pharmacy_sales", "negative_sentiment", "aqi", "disease_risk_score")
SIGNALS = ("pharmacy_sales", "negative_sentiment", "aqi")
CORRELATED = ("pharmacy_sales", "negative_sentiment", "temperature_c", "aqi", "er_visits")


def last_days(df: DataFrame, days: int | None) -> DataFrame:
    """Rows from the latest date minus ``days``, inclusive; None or 0 keeps all."""
    if not days:
        return df
    return df.filter(F.col("date") >= F.date_sub(one_row(df, last=F.max("date"))["last"], days))


def snapshot(df: DataFrame, window_days: int | None = None) -> DataFrame:
    """One row per region over the last days: means, anomaly sums, first known location."""
    aggregates = (
        [F.avg(c).alias(c) for c in present(df, SNAPSHOT_MEANS)]
        + [F.sum(c).alias(c) for c in present(df, SNAPSHOT_SUMS)]
        + [earliest(c).alias(c) for c in present(df, SNAPSHOT_FIRSTS)]
    )
    return last_days(df, window_days).groupBy("zipcode").agg(*aggregates)


def map_summary(df: DataFrame, window_days: int = 30, levels: DataFrame | None = None) -> DataFrame:
    """Recent means per region with its risk level, stored or from the score."""
    recent = last_days(df, window_days).groupBy("zipcode").agg(
        *[F.avg(c).alias(c) for c in present(df, MAP_MEANS)],
        *[earliest(c).alias(c) for c in present(df, SNAPSHOT_FIRSTS)],
    )
    if levels is not None:
        return lookup_with_default(recent, levels, "zipcode", "risk_level", "Low")
    return recent.withColumn("risk_level", risk_level_exclusive(F.col("disease_risk_score")))


def filter_levels(summary: DataFrame, selected: Sequence[str] | None) -> DataFrame:
    """Selected risk levels; an empty selection keeps all."""
    return summary.filter(F.col("risk_level").isin(list(selected))) if selected else summary


def risk_distribution(summary: DataFrame) -> DataFrame:
    """Counts over the fixed levels, zeros included, in display order."""
    row = summary.agg(*[F.count_if(F.col("risk_level") == level).alias(level) for level in P.RISK_LEVELS])
    entries = [
        F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(level).alias("risk_level"), F.col(level).alias("n"))
        for i, level in enumerate(P.RISK_LEVELS)
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*").orderBy("ord")


def kpis(df: DataFrame, summary: DataFrame, window_days: int = 30) -> DataFrame:
    high = one_row(summary, n=F.count_if(F.col("risk_level") == "High"))["n"]
    return (
        last_days(df, window_days)
        .agg(
            F.avg("er_visits").alias("avg_er_visits"),
            F.avg("aqi").alias("avg_aqi"),
            F.avg("negative_sentiment").alias("avg_negative_sentiment"),
        )
        .withColumn("n_high", high)
    )


def top_regions(df: DataFrame, n: int = 15, score: str = "disease_risk_score") -> DataFrame:
    """The n regions with the highest mean score."""
    means = df.groupBy("zipcode").agg(F.avg(score).alias(score)).filter(F.col(score).isNotNull())
    return means.orderBy(F.col(score).desc(), "zipcode").limit(n)


def risk_heatmap(df: DataFrame, n: int = 15, days: int = 60, score: str = "disease_risk_score") -> DataFrame:
    """Top regions by day in long form, empty cells 0.

    The days of the window are at most ``days + 1`` values; each top region is
    expanded over them and met with its means in an equi-join.
    """
    recent = last_days(df, days)
    cells = recent.groupBy("zipcode", "date").agg(F.avg(score).alias(score))
    grid_days = one_row(cells.filter(F.col(score).isNotNull()), days=F.sort_array(F.collect_set("date")))["days"]
    grid = top_regions(recent, n, score).select("zipcode", F.explode(grid_days).alias("date"))
    return grid.join(cells, ["zipcode", "date"], "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def risk_heatmap_wide(df: DataFrame, n: int = 15, days: int = 60, score: str = "disease_risk_score") -> DataFrame:
    """The same cells with one column per day; days are named by their age, 0 = latest."""
    long = risk_heatmap(df, n, days, score)
    last = one_row(df, last=F.max("date"))["last"]
    age = F.datediff(last, "date").cast("string")
    pivoted = long.withColumn("age", age).groupBy("zipcode").pivot("age", [str(d) for d in range(days + 1)])
    return pivoted.agg(F.first(score)).na.fill(0.0).orderBy("zipcode")


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of the rows that have both; null where a column is constant there, which ``corr`` divides by."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))


def correlation_matrix(df: DataFrame, zipcode: str | None = None, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """Pearson matrix in long form from one aggregate."""
    columns = present(df, columns)
    rows = df if zipcode is None else df.filter(F.col("zipcode") == zipcode)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = rows.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("corr"))
        for a, b in pairs
        for x, y in dict.fromkeys([(a, b), (b, a)])
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def target_correlations(df: DataFrame, target: str = P.TARGET, n: int = 20) -> DataFrame:
    """Numeric columns by absolute correlation with the target, strongest first; those without one are null and last."""
    columns = [c for c in numeric_columns(df) if c != target]
    row = df.agg(*[F.abs(correlation(c, target)).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("abs_corr")) for c in columns]
    tall = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return tall.withColumn("abs_corr", F.nanvl("abs_corr", F.lit(None))).orderBy(F.col("abs_corr").desc_nulls_last(), "feature").limit(n)


def region_means(df: DataFrame, column: str = "pharmacy_sales") -> DataFrame:
    return df.groupBy("zipcode").agg(F.avg(column).alias(column)).orderBy(F.col(column).desc(), "zipcode")


def score_histogram(df: DataFrame, score: str = "disease_risk_score", bins: int = 50) -> DataFrame:
    """Counts per region and equal bin of [0, 1]; the last bin is closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("bigint")
    return df.filter(F.col(score).isNotNull()).groupBy("zipcode", b.alias("bin")).agg(F.count("*").alias("n"))


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("start"), F.max("date").alias("end"))


def region_keys(df: DataFrame) -> DataFrame:
    return df.select(F.col("zipcode").cast("string").alias("zipcode")).distinct().orderBy("zipcode")


def region_series(df: DataFrame, zipcode: str, start=None, end=None) -> DataFrame:
    rows = df.filter(F.col("zipcode") == str(zipcode))
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
    return rows.orderBy("date")


def anomaly_rows(df: DataFrame, column: str = "er_visits") -> DataFrame:
    return df.filter(F.col(f"{column}_anomaly") == 1).select("zipcode", "date", column)


def forecast_line(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Each region's last actual point followed by the forecast after it."""
    ends = actual.groupBy("zipcode").agg(F.max("date").alias("last"))
    last = actual.join(ends, "zipcode").filter("date = last").select("zipcode", F.col("date").alias("ds"), F.col(P.TARGET).cast("double").alias("y"))
    after = forecast.join(ends, "zipcode").filter("ds > last").select("zipcode", "ds", F.col("yhat").alias("y"))
    return last.unionByName(after)


def forecast_band(forecast: DataFrame) -> DataFrame:
    """Outline of the band: upper series by date, then the lower series backwards."""
    day = F.datediff("ds", F.lit("1970-01-01").cast("date"))
    upper = forecast.select("zipcode", F.lit(0).alias("side"), day.alias("ord"), "ds", F.col("yhat_upper").alias("y"))
    lower = forecast.select("zipcode", F.lit(1).alias("side"), (-day).alias("ord"), "ds", F.col("yhat_lower").alias("y"))
    return upper.unionByName(lower).orderBy("zipcode", "side", "ord")


def top_risk_series(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Days of the High region with the highest score."""
    best = (
        summary.filter(F.col("risk_level") == "High").orderBy(F.col("disease_risk_score").desc(), "zipcode").limit(1)
    )
    return df.join(best.select("zipcode"), "zipcode", "left_semi")


def signals_long(df: DataFrame, zipcode: str | None = None, signals: Sequence[str] = SIGNALS) -> DataFrame:
    rows = df if zipcode is None else df.filter(F.col("zipcode") == zipcode)
    return rows.unpivot(["zipcode", "date"], present(df, signals), "signal", "value")
