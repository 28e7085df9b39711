"""The feature job: all windowed columns of the panel from one Window node."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import params as P
from ..functions import windows
from ..functions.calendar import calendar_columns
from ..functions.guards import present
from ..functions.scores import with_interactions, with_risk_score
from .clean import drop_missing_target


@dataclass(frozen=True)
class FeatureOptions:
    """What the job computes; the defaults are the production values."""

    lag_days: Sequence[int] = P.LAG_DAYS
    rolling_windows: Sequence[int] = P.ROLLING_WINDOWS
    rolling_stats: Sequence[str] = P.ROLLING_STATS
    target: str = P.TARGET
    anomaly_threshold: float = P.ANOMALY_THRESHOLD
    anomaly_method: str = "zscore"  # or "seasonal": residuals of a weekly decomposition


DEFAULTS = FeatureOptions()


def windowed_features(df: DataFrame, imputed: bool = True, options: FeatureOptions = DEFAULTS) -> DataFrame:
    """Calendar, lag, rolling, change and anomaly columns in one projection.

    ``imputed=False`` pads the change columns forward first, which costs a second
    Window node on the same exchange and sort.
    """
    if options.anomaly_method not in ("zscore", "seasonal"):
        raise ValueError(f"no anomaly method {options.anomaly_method!r}")
    change_columns = present(df, P.CHANGE_COLUMNS)
    new = {
        **calendar_columns(),
        **windows.lags(present(df, P.LAG_COLUMNS), options.lag_days),
        **windows.rolling(present(df, P.ROLLING_COLUMNS), options.rolling_windows, options.rolling_stats),
    }
    anomaly_columns = present(df, P.ANOMALY_COLUMNS)
    later = {}
    if options.anomaly_method == "zscore":
        new.update(windows.zscores(anomaly_columns))
        later = windows.flags(anomaly_columns, options.anomaly_threshold)
    earlier = windows.earlier_values(change_columns) if imputed else {}
    if imputed:
        later.update(windows.pct_changes(change_columns))
    out = df.withColumns({**new, **earlier}).withColumns(later).drop(*earlier)
    if options.anomaly_method == "seasonal":
        scored = windows.seasonal_anomalies(out, anomaly_columns, threshold=options.anomaly_threshold)
        out = scored.drop(*(f"{c}_stl_resid" for c in anomaly_columns))
    return out if imputed else with_pct_changes(out, change_columns)


def with_pct_changes(df: DataFrame, columns=P.CHANGE_COLUMNS, periods=P.CHANGE_PERIODS) -> DataFrame:
    """Percent changes of columns that may have nulls: padded forward first."""
    columns = present(df, columns)
    kept = {f"_raw_{c}": c for c in columns}
    raw = df.withColumns({new: df[c] for new, c in kept.items()})
    padded = windows.pad_forward(raw, columns).withColumns(windows.earlier_values(columns, periods))
    padded = padded.withColumns(windows.pct_changes(columns, periods))
    names = [f"{c}_pct_change_{p}" for c in columns for p in periods]
    restored = padded.withColumns({c: padded[new] for new, c in kept.items()})
    return restored.select(*df.columns, *names)


def feature_panel(df: DataFrame, imputed: bool = True, options: FeatureOptions = DEFAULTS) -> DataFrame:
    """Full feature panel: windowed columns, interactions, composite score, target present.

    The global maxima behind the last two steps come from scalar subqueries; keep
    ``df`` with ``session.reuse`` so that they and the main branch read it once.
    """
    base = windowed_features(df, imputed, options)
    crossed = with_interactions(base, df)
    return drop_missing_target(with_risk_score(crossed), options.target)
