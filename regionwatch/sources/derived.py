"""Signal sources derived from the star-schema and event tables.

Each source is one scan of the columns it needs and one partially aggregated
grouping by (date, zipcode). Money and quantity are summed as whole hundredths, so
the result does not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import params as P
from ..functions.scores import aqi_category
from .tables import scan
from ..operators.merge import attach_regions, outer_merge, region_table

REGION_COUNT = 15


# --- Fixed values: table schemas, declared so that no scan starts with a footer job ---
TABLES = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return scan(spark, f"{folder}/{table}.parquet", TABLES[table])


def region_key(key: str) -> Column:
    return (F.lit(10000) + F.col(key) % REGION_COUNT).cast("string")


def daily(df: DataFrame, day: str, key: str, *aggregates: Column) -> DataFrame:
    """Aggregate by day and region number; the text key is made once per group, not per row."""
    grouped = df.groupBy(F.to_date(day).alias("date"), (F.col(key) % REGION_COUNT).alias("_region"))
    out = grouped.agg(*aggregates)
    values = [c for c in out.columns if c not in ("date", "_region")]
    return out.select("date", (F.lit(10000) + F.col("_region")).cast("string").alias("zipcode"), *values)


def exact_sum(column: str) -> Column:
    """Sum of a two-decimal column in whole hundredths: independent of the order of the
    rows, and far cheaper per row than a decimal cast."""
    return F.sum(F.floor(F.col(column) * 100 + 0.5)) / F.lit(100.0)


def exact_mean(column: str) -> Column:
    return exact_sum(column) / F.count(column)


def pharmacy(spark: SparkSession, folder: str) -> DataFrame:
    return daily(
        read(spark, folder, "orders"), "o_orderdate", "o_custkey",
        (exact_sum("o_totalprice") / 1000).alias("pharmacy_sales"),
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("outbreak_event"),
    )


def social_media(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count("*")
    return daily(
        read(spark, folder, "lineitem"), "l_shipdate", "l_suppkey",
        (F.count_if(F.col("l_returnflag") == "R") / n).alias("negative_sentiment"),
        n.alias("post_volume"),
        (F.count_if(F.col("l_linestatus") == "O") / n).alias("symptom_mention_rate"),
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    return daily(
        read(spark, folder, "lineitem"), "l_shipdate", "l_partkey",
        (exact_mean("l_quantity") - 8).alias("temperature_c"),
        (exact_mean("l_tax") * 1000).alias("humidity_pct"),
        (F.max("l_discount") * 100).alias("precipitation_mm"),
        (F.sum("l_linenumber") / F.count("*") * 5).alias("wind_speed_kmh"),
    )


def air(spark: SparkSession, folder: str) -> DataFrame:
    price = exact_mean("l_extendedprice")
    rows = daily(
        read(spark, folder, "lineitem"), "l_shipdate", "l_orderkey",
        (price / 500).alias("aqi"), (price / 1250).alias("pm25_ugm3"),
    )
    return rows.withColumn("aqi_category", aqi_category(F.col("aqi")))


def er_visits(spark: SparkSession, folder: str) -> DataFrame:
    return daily(
        read(spark, folder, "orders"), "o_orderdate", "o_orderkey",
        (F.count("*") * 10 + F.count_if(F.col("o_orderstatus") == "F") * 5).alias("er_visits"),
    )


def long_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "pharmacy": pharmacy(spark, folder),
        "social_media": social_media(spark, folder),
        "weather": weather(spark, folder),
        "aqi": air(spark, folder),
        "er_visits": er_visits(spark, folder),
    }


def panel_regions(spark: SparkSession) -> DataFrame:
    """The configured regions under the panel's keys, by position."""
    rows = [(str(10000 + i), city, state, lat, lon) for i, (_, city, state, lat, lon) in enumerate(P.REGIONS)]
    return region_table(spark, rows)


def long_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Outer merge of the five sources with the region dimension."""
    merged = outer_merge(long_sources(spark, folder), unique=True)
    return attach_regions(merged, panel_regions(spark))


def event_sources(events: DataFrame) -> dict[str, DataFrame]:
    """Short panel: one source per event type, from one filtered scan each."""
    keyed = events.withColumns({"date": F.to_date("ts"), "zipcode": region_key("user_id")})

    def of(kind: str) -> DataFrame:
        return keyed.filter(F.col("event_type") == kind).groupBy("date", "zipcode")

    return {
        "pharmacy": of("purchase").agg(exact_sum("value").alias("pharmacy_sales")),
        "social_media": of("view").agg(F.count("*").alias("post_volume")),
        "aqi": of("click").agg(exact_mean("value").alias("aqi")),
        "er_visits": of("signup").agg(F.count("*").alias("er_visits")),
    }
