"""The tables an interactive dashboard reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..operators import region
from ..session import reuse


def tables(features: DataFrame, levels: DataFrame | None = None, forecast: DataFrame | None = None) -> dict[str, DataFrame]:
    """Lazy dashboard tables by name, over one kept copy of the columns they read."""
    columns = dict.fromkeys(
        ["date", "zipcode", *region.MAP_MEANS, *region.SNAPSHOT_FIRSTS, *region.SIGNALS, "er_visits_anomaly"]
    )
    panel = reuse(features.select(*columns))
    summary = region.map_summary(panel, levels=levels)
    out = {
        "summary": summary,
        "distribution": region.risk_distribution(summary),
        "kpis": region.kpis(panel, summary),
        "heatmap": region.risk_heatmap(panel),
        "anomalies": region.anomaly_rows(panel),
        "signals": region.signals_long(panel),
        "regions": region.region_keys(panel),
    }
    if forecast is not None:
        out["forecast_line"] = region.forecast_line(panel, forecast)
        out["forecast_band"] = region.forecast_band(forecast)
    return out


def save(named: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    for name, df in named.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")
