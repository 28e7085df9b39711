"""Explicit schemas, scans and scan filters of the five signal sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- Fixed values: source schemas -------------------------------------------
SOURCE_SCHEMAS = {
    "pharmacy": "date date, zipcode string, pharmacy_sales double, outbreak_event boolean",
    "social_media": (
        "date date, zipcode string, negative_sentiment double, post_volume bigint, symptom_mention_rate double"
    ),
    "weather": (
        "date date, zipcode string, temperature_c double, humidity_pct double, "
        "precipitation_mm double, wind_speed_kmh double"
    ),
    "aqi": "date date, zipcode string, aqi double, pm25_ugm3 double, aqi_category string",
    "er_visits": "date date, zipcode string, er_visits bigint",
}


def scan(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Scan with a declared schema: no inference pass, text keys keep leading zeros."""
    reader = spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(kind).load(path)


def scan_source(spark: SparkSession, name: str, path: str, kind: str = "parquet") -> DataFrame:
    return scan(spark, path, SOURCE_SCHEMAS[name], kind)


def empty_source(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SOURCE_SCHEMAS[name])


def in_range(df: DataFrame, start=None, end=None, zipcodes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Inclusive date range and key set.

    A list of keys is inlined and reaches the scan; a frame of keys becomes a semi join.
    """
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    if zipcodes is None:
        return df
    df = df.withColumn("zipcode", F.col("zipcode").cast("string"))
    if not isinstance(zipcodes, DataFrame):
        return df.filter(F.col("zipcode").isin([str(z) for z in zipcodes]))
    wanted = zipcodes.select(F.col("zipcode").cast("string").alias("zipcode"))
    return df.join(wanted, "zipcode", "left_semi")


def collect_sources(
    spark: SparkSession,
    available: Mapping[str, DataFrame | str | None],
    start=None,
    end=None,
    zipcodes: Sequence[str] | DataFrame | None = None,
    kind: str = "parquet",
) -> dict[str, DataFrame]:
    """The five named sources, filtered; a missing one is an empty frame with its columns."""
    out = {}
    for name in SOURCE_SCHEMAS:
        given = available.get(name)
        if given is None:
            out[name] = empty_source(spark, name)
            continue
        df = scan_source(spark, name, given, kind) if isinstance(given, str) else given
        out[name] = in_range(df, start, end, zipcodes)
    return out
