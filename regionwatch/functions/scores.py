"""Scalar scores: interactions, normalisation, composite risk, levels, metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .. import params as P
from .guards import clip, ratio_or, with_statistics


def aqi_category(value: Column, mode: str = "contiguous") -> Column:
    """Six labels. ``contiguous`` closes the gaps between the integer buckets;
    ``reference`` keeps them, so 50.3 falls through to the last label."""
    labels = P.AQI_CATEGORIES
    out = None
    low = 0
    for high, label in labels:
        hit = value <= high if mode == "contiguous" else value.between(low, high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
        low = high + 1
    return F.when(value.isNotNull(), out.otherwise(labels[-1][1]))


def temperature_extremity(temperature: Column) -> Column:
    return F.abs(temperature - P.COMFORT_TEMPERATURE_C)


def heat_index(temperature: Column, humidity: Column) -> Column:
    vapour = humidity / 100 * 6.105 * F.exp(17.27 * temperature / (237.7 + temperature))
    return temperature + 0.33 * vapour - 4


def with_interactions(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Add the interaction terms of the signals the frame has.

    ``source`` holds the same sales values; the global maximum is read from it.
    """
    have = set(df.columns)
    out: dict[str, Column] = {}
    base = df
    if {"temperature_c", "aqi"} <= have:
        out["temp_x_aqi"] = temperature_extremity(F.col("temperature_c")) * F.col("aqi") / 100
    if {"negative_sentiment", "pharmacy_sales"} <= have:
        base = with_statistics(df, source or df, "_sales", top=F.max("pharmacy_sales"))
        product = F.col("negative_sentiment") * F.col("pharmacy_sales")
        out["sentiment_x_pharmacy"] = ratio_or(product, F.col("_sales.top"), None)
    if {"humidity_pct", "temperature_c"} <= have:
        out["heat_index"] = heat_index(F.col("temperature_c"), F.col("humidity_pct"))
    return base.withColumns(out).select(*df.columns, *out)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); a constant column gives 0."""
    return F.when(high == low, F.lit(0.0)).otherwise((value - low) / F.when(high != low, high - low))


def with_minmax(df: DataFrame, values: dict[str, Column], name: str = "_bounds") -> tuple[DataFrame, dict[str, Column]]:
    """Global min-max of several expressions from one aggregate, kept in a struct column."""
    bounded = with_statistics(
        df,
        df,
        name,
        **{f"lo_{n}": F.min(v) for n, v in values.items()},
        **{f"hi_{n}": F.max(v) for n, v in values.items()},
    )
    return bounded, {n: minmax(v, F.col(f"{name}.lo_{n}"), F.col(f"{name}.hi_{n}")) for n, v in values.items()}


def anomaly_count(df: DataFrame) -> Column | None:
    flags = [c for c in df.columns if c.endswith("_anomaly")]
    if not flags:
        return None
    total = F.coalesce(F.col(flags[0]), F.lit(0))
    for c in flags[1:]:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total.cast("double")


def risk_components(df: DataFrame) -> dict[str, Column]:
    """Raw score components present in the frame, in weight order."""
    parts: dict[str, Column] = {
        c: F.col(c) for c in ("pharmacy_sales", "negative_sentiment", "aqi") if c in df.columns
    }
    if "temperature_c" in df.columns:
        parts["temp_extreme"] = temperature_extremity(F.col("temperature_c"))
    count = anomaly_count(df)
    if count is not None:
        parts["anomaly_count"] = count
    return parts


def with_risk_score(df: DataFrame, output: str = "disease_risk_score") -> DataFrame:
    """Weighted mean of the min-max normalised components, within [0, 1]."""
    parts = risk_components(df)
    if not parts:
        return df.withColumn(output, F.lit(0.0))
    bounded, scaled = with_minmax(df, parts)
    weight = sum(P.SCORE_WEIGHTS[n] for n in scaled)
    total = None
    for name, value in scaled.items():
        term = F.lit(P.SCORE_WEIGHTS[name]) * value
        total = term if total is None else total + term
    return bounded.withColumn(output, clip(total / F.lit(weight), 0.0, 1.0)).drop("_bounds")


def risk_level(score: Column, low: float = P.LOW_THRESHOLD, medium: float = P.MEDIUM_THRESHOLD) -> Column:
    return F.when(score < low, "Low").when(score < medium, "Medium").otherwise("High")


def risk_level_exclusive(score: Column) -> Column:
    """Variant with strict lower bounds, used only where no stored level exists."""
    return (
        F.when(score > P.MEDIUM_THRESHOLD, "High").when(score > P.LOW_THRESHOLD, "Medium").otherwise("Low")
    )


def risk_color(level: Column) -> Column:
    out = None
    for name, color in P.RISK_COLORS.items():
        out = F.when(level == name, color) if out is None else out.when(level == name, color)
    return out.otherwise(P.UNKNOWN_COLOR)


def metric_columns(actual: Column, predicted: Column, names: Iterable[str] = ("mae", "rmse", "mape"), epsilon: float = 1.0) -> dict[str, Column]:
    """Aggregate expressions of the known metric names; unknown names are skipped."""
    error = actual - predicted
    known = {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(F.abs(error / (F.abs(actual) + F.lit(epsilon)))) * 100,
    }
    return {n: known[n] for n in names if n in known}
