"""Scaler parameters as a small table; transform and inverse as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.guards import with_statistics
from .quality import unstack


def fit(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """(column, shift, scale): population moments for standard, range for minmax.

    A constant column gets scale 1.
    """
    if method == "standard":
        shift, spread = F.avg, F.stddev_pop
    elif method == "minmax":
        shift, spread = F.min, lambda c: F.max(c) - F.min(c)
    else:
        raise ValueError(f"unknown scaler method: {method}")
    row = df.agg(*[a.cast("double").alias(n) for c in columns for n, a in ((f"{c}__shift", shift(c)), (f"{c}__scale", spread(c)))])
    return unstack(row, columns, ["shift", "scale"]).withColumn(
        "scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    )


def _with_params(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    pick = lambda c, f: F.max(F.when(F.col("column") == c, F.col(f)))
    base = with_statistics(
        df, params, "_p", **{f"{f}_{i}": pick(c, f) for i, c in enumerate(columns) for f in ("shift", "scale")}
    )
    return base, {c: (F.col(f"_p.shift_{i}"), F.col(f"_p.scale_{i}")) for i, c in enumerate(columns)}


def transform(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    base, p = _with_params(df, params, columns)
    return base.withColumns({c: (F.col(c) - a) / b for c, (a, b) in p.items()}).drop("_p")


def inverse(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    base, p = _with_params(df, params, columns)
    return base.withColumns({c: F.col(c) * b + a for c, (a, b) in p.items()}).drop("_p")
