"""Window expressions over one region's days.

Every builder returns ``{name: Column}`` over the same (zipcode, date) window
specification, so a job can gather all of them in one ``select`` and Spark plans
one exchange, one sort and one Window node. Frames are row based.

Size bound: the frames below expect a panel with one row per (date, zipcode)
(``operators.merge`` and ``operators.clean`` guarantee it), so one window
partition never holds more rows than there are calendar days, however many raw
rows a region has.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import params as P
from .guards import present


def by_date():
    return W.partitionBy("zipcode").orderBy("date")


def whole():
    return W.partitionBy("zipcode")


# Expressions are SQL text: one call to the JVM each, where a column built step by
# step takes a dozen, and the feature job has more than a hundred.
SPEC = "PARTITION BY zipcode ORDER BY date"


def trailing(rows: int) -> str:
    return f"OVER ({SPEC} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def lags(columns: Iterable[str], days: Iterable[int] = P.LAG_DAYS) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.expr(f"lag(`{c}`, {k}) OVER ({SPEC})") for c in columns for k in days}


# --- Fixed values: rolling statistics; a single row has deviation 0 ---
ROLLING = {
    "mean": "avg(`{c}`) {w}",
    "std": "coalesce(stddev_samp(`{c}`) {w}, 0D)",
    "max": "max(`{c}`) {w}",
    "min": "min(`{c}`) {w}",
    "sum": "sum(`{c}`) {w}",
}


def rolling(
    columns: Iterable[str],
    windows: Iterable[int] = P.ROLLING_WINDOWS,
    stats: Iterable[str] = P.ROLLING_STATS,
) -> dict[str, Column]:
    return {
        f"{c}_roll_{n}_{s}": F.expr(ROLLING[s].format(c=c, w=trailing(n)))
        for c in columns for n in windows for s in stats
    }


def pad_forward(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Replace nulls with the region's last earlier value."""
    running = f"OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return df.withColumns({c: F.expr(f"last(`{c}`, true) {running}") for c in columns})


def earlier_values(columns: Iterable[str], periods: Iterable[int] = P.CHANGE_PERIODS) -> dict[str, Column]:
    """The values ``pct_changes`` compares with; windowed once, then read several times."""
    return {f"_before_{c}_{p}": F.expr(f"lag(`{c}`, {p}) OVER ({SPEC})") for c in columns for p in periods}


def pct_changes(
    columns: Iterable[str], periods: Iterable[int] = P.CHANGE_PERIODS, limit: float = P.CHANGE_LIMIT
) -> dict[str, Column]:
    """current / earlier - 1 within +-limit; no earlier value, or 0/0, gives 0.

    Reads the columns of ``earlier_values``. Expects signals without inner nulls
    (imputed, or ``pad_forward`` first).
    """
    text = (
        "CASE WHEN `_before_{c}_{p}` = 0 THEN if(`{c}` > 0, {m}D, if(`{c}` < 0, -{m}D, 0D)) "
        "WHEN `{c}` IS NULL OR `_before_{c}_{p}` IS NULL THEN 0D "
        "ELSE greatest(least(`{c}` / `_before_{c}_{p}` - 1, {m}D), -{m}D) END"
    )
    return {f"{c}_pct_change_{p}": F.expr(text.format(c=c, p=p, m=limit)) for c in columns for p in periods}


def rolling_zscore(
    column: str,
    window: int = P.ANOMALY_WINDOW,
    min_values: int = P.ANOMALY_MIN_VALUES,
    epsilon: float = P.STD_EPSILON,
) -> Column:
    """(x - mean) / (std + epsilon) over the trailing rows; too few values or a constant frame gives 0."""
    c, w = f"`{column}`", trailing(window)
    return F.expr(
        f"coalesce(CASE WHEN count({c}) {w} >= {min_values} AND max({c}) {w} > min({c}) {w} "
        f"THEN ({c} - avg({c}) {w}) / (stddev_samp({c}) {w} + {epsilon!r}D) END, 0D)"
    )


def strict_zscore(column: str, window: int = P.ANOMALY_WINDOW) -> Column:
    """As ``rolling_zscore`` but only over a full frame and without epsilon."""
    return rolling_zscore(column, window, window, 0.0)


def flag(z: Column, threshold: float = P.ANOMALY_THRESHOLD) -> Column:
    return (F.abs(z) > threshold).cast("int")


def zscores(columns: Iterable[str] = P.ANOMALY_COLUMNS, window: int = P.ANOMALY_WINDOW) -> dict[str, Column]:
    return {f"{c}_zscore": rolling_zscore(c, window) for c in columns}


def flags(columns: Iterable[str] = P.ANOMALY_COLUMNS, threshold: float = P.ANOMALY_THRESHOLD) -> dict[str, Column]:
    """Anomaly flags from the z-score columns, after these are computed."""
    return {f"{c}_anomaly": flag(F.col(f"{c}_zscore"), threshold) for c in columns}


def with_zscore_anomalies(
    df: DataFrame,
    columns: Iterable[str] = P.ANOMALY_COLUMNS,
    window: int = P.ANOMALY_WINDOW,
    threshold: float = P.ANOMALY_THRESHOLD,
) -> DataFrame:
    columns = present(df, columns)
    return df.withColumns(zscores(columns, window)).withColumns(flags(columns, threshold))


def seasonal_residuals(df: DataFrame, columns: Iterable[str], period: int = P.SEASONAL_PERIOD) -> DataFrame:
    """Add ``{c}_stl_resid``: value - centred moving average - re-centred phase mean.

    Regions with fewer than two periods get 0. The phase of a row is its position
    in the region modulo the period.
    """
    columns = present(df, columns)
    half = period // 2
    centred = by_date().rowsBetween(-half, half)
    parts = df.withColumns(
        {
            "_phase": F.row_number().over(by_date()) % period,
            "_days": F.count("*").over(whole()),
            **{f"_trend_{c}": F.avg(c).over(centred) for c in columns},
        }
    )
    by_phase = W.partitionBy("zipcode", "_phase")
    parts = parts.withColumns(
        {f"_phase_{c}": F.avg(F.col(c) - F.col(f"_trend_{c}")).over(by_phase) for c in columns}
    )
    parts = parts.withColumns({f"_centre_{c}": F.avg(f"_phase_{c}").over(whole()) for c in columns})
    residual = {
        f"{c}_stl_resid": F.when(
            F.col("_days") >= 2 * period,
            F.coalesce(
                F.col(c) - F.col(f"_trend_{c}") - (F.col(f"_phase_{c}") - F.col(f"_centre_{c}")), F.lit(0.0)
            ),
        ).otherwise(F.lit(0.0))
        for c in columns
    }
    return parts.withColumns(residual).select(*df.columns, *residual)


def seasonal_anomalies(
    df: DataFrame,
    columns: Iterable[str] = P.ANOMALY_COLUMNS,
    period: int = P.SEASONAL_PERIOD,
    threshold: float = P.ANOMALY_THRESHOLD,
) -> DataFrame:
    """Residual z-score and flag: residual / (std of the region's residuals + epsilon)."""
    columns = present(df, columns)
    out = seasonal_residuals(df, columns, period)
    scores = {
        c: F.col(f"{c}_stl_resid")
        / (F.coalesce(F.stddev_samp(f"{c}_stl_resid").over(whole()), F.lit(1.0)) + F.lit(P.STD_EPSILON))
        for c in columns
    }
    new: dict[str, Column] = {}
    for c, z in scores.items():
        new[f"{c}_zscore"] = z
        new[f"{c}_anomaly"] = flag(z, threshold)
    return out.withColumns(new)


def fill_within_region(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Forward then backward fill.

    After the forward fill only the rows before a region's first value are empty,
    so the backward fill is that first value: one window specification, one sort.
    """
    running = f"OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    all_days = f"OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return df.withColumns(
        {c: F.expr(f"coalesce(last(`{c}`, true) {running}, first(`{c}`, true) {all_days})") for c in columns}
    )


def densify(df: DataFrame) -> DataFrame:
    """Add the missing days of each region, so row-based frames become calendar based."""
    span = df.groupBy("zipcode").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("zipcode", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    return days.join(df, ["zipcode", "date"], "left").select(*df.columns)
