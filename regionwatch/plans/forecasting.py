"""Forecast job: seasonal models per region, the global lag regression, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import params as P
from ..operators import forecast, lag_regression, metrics
from ..session import reuse


@dataclass(frozen=True)
class Forecasts:
    models: DataFrame
    forecast: DataFrame
    results: DataFrame
    summary: DataFrame
    average: DataFrame | None  # without mae and rmse: none
    recursive: DataFrame | None = None


def run(
    train: DataFrame,
    test: DataFrame,
    horizon: int = P.FORECAST_HORIZON,
    with_lag_regression: bool = True,
    regressor_fill: str = "last",
    options: forecast.SeasonalOptions = forecast.SeasonalOptions(),
    width: float = P.INTERVAL_WIDTH,
    regions: Sequence[str] | None = None,
    target: str = P.TARGET,
    regressors: Sequence[str] = P.REGRESSORS,
    chosen_metrics: Sequence[str] = metrics.METRICS,
) -> Forecasts:
    """Fit on train, forecast ``horizon`` days past it, evaluate on test.

    ``regions`` picks the regions of the seasonal models; the lag regression is one model of all of them.
    """
    some = train if regions is None else train.filter(F.col("zipcode").isin(list(map(str, regions))))
    frame = forecast.forecast_frame(some, target, regressors)
    models = reuse(forecast.fit(frame, options=options))
    ahead = forecast.predict(models, forecast.future_frame(frame, horizon, regressor_fill), width)
    held_out = forecast.forecast_frame(test, target, regressors)
    scored = metrics.align(forecast.predict(models, held_out.drop("y"), width), test, target)
    results = metrics.evaluate(scored.withColumn("model", F.lit("seasonal")), ["model", "zipcode"], metrics=chosen_metrics)
    recursive = None
    if with_lag_regression:
        signals = tuple(dict.fromkeys((*lag_regression.SIGNALS, target)))
        model, _ = lag_regression.fit(train, signals, target)
        globally = lag_regression.evaluate_sequences(model, test, target, chosen_metrics).withColumn("zipcode", F.lit("all"))
        results = results.unionByName(globally)
        recursive = lag_regression.forecast(model, train, horizon, target)
    seasonal = results.filter("model = 'seasonal'")
    averaged = [m for m in ("mae", "rmse") if m in results.columns]
    return Forecasts(models, ahead, results, metrics.summary(results), metrics.overall(seasonal, averaged) if averaged else None, recursive)
