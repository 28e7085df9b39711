"""Lookback sequences per region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import params as P
from ..functions.windows import by_date


def lookback_sequences(
    df: DataFrame, features: Sequence[str], target: str = P.TARGET, lookback: int = P.LOOKBACK
) -> DataFrame:
    """For each row with ``lookback`` earlier rows: their features, oldest first, and its target.

    Rows with a null feature or target are dropped first. The collected array has
    exactly ``lookback`` elements.
    """
    usable = df.na.drop(subset=[*features, target])
    row = F.array(*[F.col(f).cast("double") for f in features])
    return (
        usable.withColumns(
            {
                "x": F.collect_list(row).over(by_date().rowsBetween(-lookback, -1)),
                "_rank": F.row_number().over(by_date()),
            }
        )
        .filter(F.col("_rank") > lookback)
        .select("zipcode", "date", "x", F.col(target).cast("double").alias("y"))
    )


def last_rows(df: DataFrame, n: int = P.LOOKBACK) -> DataFrame:
    """The last n rows of every region by date, limited on the map side."""
    newest = W.partitionBy("zipcode").orderBy(F.col("date").desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")
