"""Null-safe column helpers and one-row statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def clip(value: Column, low=None, high=None) -> Column:
    """Clip to [low, high]; a missing value stays missing."""
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), out)


def ratio_or(numerator: Column, denominator: Column, default) -> Column:
    """numerator / denominator, or the default where the denominator is zero or missing."""
    usable = denominator.isNotNull() & (denominator != 0)
    return F.when(usable, numerator / F.when(usable, denominator)).otherwise(F.lit(default))


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Columns of the list that the frame has, known at plan time."""
    return [c for c in columns if c in df.columns]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """Global statistics as a scalar subquery: one partial aggregate, one value per query.

    The result is a struct column usable over any frame, so no join and no
    unpartitioned window is needed. Every mention of it copies the subquery into
    the plan: refer to it once, or use ``with_statistics``.
    """
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("s")).scalar()


def with_statistics(df: DataFrame, source: DataFrame, name: str, **aggregates: Column) -> DataFrame:
    """Add the one-row statistics of ``source`` as a struct column, so that any number
    of expressions can read its fields from one subquery."""
    return df.withColumn(name, one_row(source, **aggregates))


def earliest(column: str, order: str = "date") -> Column:
    """First non-null value by date, as an aggregate with a declared order."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))
