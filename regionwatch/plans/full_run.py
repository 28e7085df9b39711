"""Hotspot job and the full batch run: sources to written results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import params as P
from ..operators import clean, hotspots, region
from ..session import released, reuse
from ..sources import sinks
from . import forecasting, jobs


@dataclass(frozen=True)
class HotspotResult:
    regions: DataFrame
    features: DataFrame
    metadata: DataFrame
    summary: DataFrame


def hotspot_job(features: DataFrame, window_days: int = 30, **parameters) -> HotspotResult:
    """Snapshot, cluster, map features and summaries; parameters as of ``hotspots.detect``."""
    labelled = reuse(hotspots.detect(region.snapshot(features, window_days), **parameters))
    return HotspotResult(
        labelled, hotspots.map_features(labelled), hotspots.metadata(labelled), hotspots.cluster_summary(labelled)
    )


def full_run(
    sources: Mapping[str, DataFrame | None],
    regions: DataFrame | None,
    folder: str,
    window_days: int = 30,
    horizon: int = P.FORECAST_HORIZON,
    unique: bool = False,
    feature_options: Mapping[str, object] | None = None,
    hotspot_options: Mapping[str, object] | None = None,
    forecast_options: Mapping[str, object] | None = None,
) -> dict[str, str]:
    """Preprocess, features, hotspots, forecasts; writes everything and returns the paths.

    The options are keyword arguments of ``jobs.feature_job``, ``hotspots.detect`` and ``forecasting.run``.
    """
    with released():
        prepared = jobs.preprocess(sources, regions, unique)
        made = jobs.feature_job(prepared.panel, **(feature_options or {}))
        written = {"features": sinks.write_table(made, f"{folder}/features", ("zipcode",))}
        # later stages read the written table instead of computing the features again; keys keep their leading zeros
        features = made.sparkSession.read.schema(made.schema).parquet(written["features"])
        train, _, test = clean.split(features)
        hot = hotspot_job(features, window_days, **(hotspot_options or {}))
        ahead = forecasting.run(train, test, horizon, **(forecast_options or {}))
        written["regions"] = sinks.write_table(hot.regions, f"{folder}/regions")
        written["map"] = sinks.write_map(hot.regions, f"{folder}/map")
        written["forecast"] = sinks.write_forecasts(ahead.forecast, f"{folder}/forecast")
        written["models"] = sinks.save_models(ahead.models, f"{folder}/models")
        reports = {"quality": prepared.report, "evaluation": ahead.results, "evaluation_summary": ahead.summary, "map_metadata": hot.metadata}
        written.update(sinks.write_reports(reports, f"{folder}/reports"))
    return written
