"""Data quality reports as tidy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.guards import numeric_columns, present
from ..functions.quantiles import exact_quantiles

SUMMARY_COLUMNS = ("pharmacy_sales", "negative_sentiment", "temperature_c", "aqi", "er_visits")


def unstack(row: DataFrame, names: Sequence[str], fields: Sequence[str], label: str = "column") -> DataFrame:
    """One wide aggregate row, with columns ``{name}__{field}``, to one row per name."""
    entries = [
        F.struct(F.lit(n).alias(label), *[F.col(f"`{n}__{f}`").alias(f) for f in fields]) for n in names
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def missing(column: str, dtype: T.DataType) -> Column:
    c = F.col(column)
    return c.isNull() | F.isnan(c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c.isNull()


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.count_distinct("zipcode").alias("n_regions"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with any missing value: count and percent (2 decimals)."""
    counts = df.agg(
        F.count("*").alias("_n"),
        *[F.count_if(missing(f.name, f.dataType)).alias(f"{f.name}__count") for f in df.schema.fields],
    )
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}__count`").alias("count")) for c in df.columns]
    return (
        counts.select("_n", F.explode(F.array(*entries)).alias("e"))
        .filter("e.count > 0")
        .select("e.column", "e.count", F.round(F.col("e.count") * 100 / F.col("_n"), 2).alias("pct"))
    )


def outlier_counts(df: DataFrame) -> DataFrame:
    flags = [c for c in df.columns if c.endswith("_outlier")]
    if not flags:
        return df.sparkSession.createDataFrame([], "column string, count bigint")
    row = df.agg(*[F.count_if(F.col(c)).alias(f"{c.removesuffix('_outlier')}__count") for c in flags])
    return unstack(row, [c.removesuffix("_outlier") for c in flags], ["count"])


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """mean, sample std, min, max and exact median per numeric column."""
    columns = list(columns or [c for c in numeric_columns(df) if not c.endswith("_outlier")])
    row = df.agg(
        *[
            agg.alias(f"{c}__{name}")
            for c in columns
            for name, agg in (
                ("mean", F.avg(c).cast("double")),
                ("std", F.stddev_samp(c)),
                ("min", F.min(c).cast("double")),
                ("max", F.max(c).cast("double")),
            )
        ]
    )
    moments = unstack(row, columns, ["mean", "std", "min", "max"])
    medians = exact_quantiles(df, columns, [0.5]).select("column", F.col("value").alias("p50"))
    out = moments.join(medians, "column", "left")
    return out.select("column", *[F.round(m, digits).alias(m) for m in ("mean", "std", "min", "max", "p50")])


def report(df: DataFrame) -> DataFrame:
    """All sections in one tidy table (section, column, metric, value)."""

    def tall(section: str, part: DataFrame, metrics: Sequence[str]) -> DataFrame:
        key = F.col("column") if "column" in part.columns else F.lit(None).cast("string")
        entries = [F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("string").alias("value")) for m in metrics]
        return part.select(
            F.lit(section).alias("section"), key.alias("column"), F.explode(F.array(*entries)).alias("e")
        ).select("section", "column", "e.metric", "e.value")

    parts = [
        tall("overview", overview(df), ["n_rows", "n_cols", "n_regions", "start", "end"]),
        tall("missing_values", missing_values(df), ["count", "pct"]),
        tall("outlier_counts", outlier_counts(df), ["count"]),
        tall("numeric_stats", numeric_stats(df), ["mean", "std", "min", "max", "p50"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def datasets_table(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """One row per dataset: rows, columns, regions, date range, mean missing percent."""

    def row(name: str, df: DataFrame) -> DataFrame:
        shares = [F.count_if(missing(f.name, f.dataType)) / F.count("*") for f in df.schema.fields]
        total = reduce(lambda a, b: a + b, shares)
        return df.agg(
            F.lit(name).alias("dataset"),
            F.count("*").alias("rows"),
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            F.count_distinct("zipcode").alias("zip_codes"),
            F.min("date").alias("start"),
            F.max("date").alias("end"),
            F.round(total / len(df.columns) * 100, 2).alias("missing_pct"),
        )

    return reduce(lambda a, b: a.unionByName(b), [row(n, d) for n, d in datasets.items()])


def describe(df: DataFrame) -> DataFrame:
    """Count, unique, top, freq, moments and quartiles of every column.

    Frequencies come from one grouping of (column, value), so no column's values
    meet in a single aggregation buffer.
    """
    numbers = numeric_columns(df)
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])
        ).alias("e")
    ).select("e.*").filter("value is not null")
    counted = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    frequency = counted.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count("*").alias("unique"),
        F.max(F.struct("n", "value")).alias("_top"),
    )
    moments = numeric_stats(df, numbers, 6).drop("p50")
    quartiles = (
        exact_quantiles(df, numbers, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("probability") == p, F.col("value"))).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    )
    return (
        frequency.select("column", "count", "unique", F.col("_top.value").alias("top"), F.col("_top.n").alias("freq"))
        .join(moments, "column", "left")
        .join(quartiles, "column", "left")
    )


def dataset_summary(df: DataFrame, columns: Sequence[str] = SUMMARY_COLUMNS) -> DataFrame:
    """Regions, date range and rows, with mean, std and max per signal."""
    columns = present(df, columns)
    row = df.agg(
        F.count_distinct("zipcode").alias("n_regions"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count("*").alias("n_rows"),
        *[
            agg.cast("double").alias(f"{c}__{name}")
            for c in columns
            for name, agg in (("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("max", F.max(c)))
        ],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{m}`").alias(m) for m in ("mean", "std", "max")])
        for c in columns
    ]
    return row.select("n_regions", "start", "end", "n_rows", F.explode(F.array(*entries)).alias("e")).select(
        "n_regions", "start", "end", "n_rows", "e.*"
    )


def distinct_by(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """One representative row per value of a column, the first in the given order."""
    w = W.partitionBy(column).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank").orderBy(column)
