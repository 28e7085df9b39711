"""Forecast metrics and evaluation summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.guards import numeric_columns
from ..functions.scores import metric_columns

METRICS = ("mae", "rmse", "mape")


def evaluate(
    pairs: DataFrame,
    by: Sequence[str] = ("model", "zipcode"),
    actual: str = "y",
    predicted: str = "yhat",
    metrics: Sequence[str] = METRICS,
    digits: int = 4,
) -> DataFrame:
    """Chosen metrics per group over rows that have both values; unknown names are skipped."""
    usable = pairs.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    chosen = metric_columns(F.col(actual).cast("double"), F.col(predicted).cast("double"), metrics)
    return usable.groupBy(*by).agg(
        F.count("*").alias("n_samples"), *[F.round(c, digits).alias(n) for n, c in chosen.items()]
    )


def align(forecast: DataFrame, actual: DataFrame, target: str = "er_visits") -> DataFrame:
    """Forecast and actual values of the same region and day."""
    truth = actual.select("zipcode", F.col("date").alias("ds"), F.col(target).cast("double").alias("y"))
    return forecast.join(truth, ["zipcode", "ds"], "inner").filter(F.col("y").isNotNull())


def summary(results: DataFrame) -> DataFrame:
    """Mean of every numeric metric per model, 4 decimals."""
    numbers = [c for c in numeric_columns(results) if c not in ("model", "region")]
    return results.groupBy("model").agg(*[F.round(F.avg(c), 4).alias(c) for c in numbers])


def overall(results: DataFrame, metrics: Sequence[str] = ("mae", "rmse")) -> DataFrame:
    """Average over regions; a region without the metric counts as 0."""
    return results.agg(*[F.avg(F.coalesce(m, F.lit(0.0))).alias(f"avg_{m}") for m in metrics])
