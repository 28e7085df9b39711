"""Flattening landed JSON payloads and posts with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import params as P

# --- Fixed values: payload schemas ------------------------------------------
WEATHER_PAYLOAD = "current struct<temp:double,humidity:double,wind_speed:double,rain:struct<`1h`:double>>"
AIR_PAYLOAD = "data struct<current:struct<pollution:struct<aqius:double,p2:struct<conc:double>>>>"
VISITS_PAYLOAD = "array<struct<date:string,visit_count:string>>"
ADDRESS_PAYLOAD = (
    "result struct<addressMatches:array<struct<coordinates:struct<x:double,y:double>,"
    "addressComponents:struct<city:string,state:string>>>>"
)
PLACE_PAYLOAD = (
    "results array<struct<geometry:struct<location:struct<lat:double,lng:double>>,"
    "address_components:array<struct<types:array<string>,long_name:string,short_name:string>>>>"
)


def flatten_weather(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Landed (date, zipcode, payload); hourly rain becomes millimetres a day, absent rain 0."""
    now = F.from_json(payload, WEATHER_PAYLOAD)["current"]
    return landed.withColumn("p", now).select(
        "date",
        "zipcode",
        F.col("p.temp").alias("temperature_c"),
        F.col("p.humidity").alias("humidity_pct"),
        (F.coalesce(F.col("p.rain.`1h`"), F.lit(0.0)) * 24).alias("precipitation_mm"),
        F.col("p.wind_speed").alias("wind_speed_kmh"),
    )


def flatten_air(landed: DataFrame, payload: str = "payload") -> DataFrame:
    now = F.from_json(payload, AIR_PAYLOAD)["data"]["current"]["pollution"]
    return landed.withColumn("p", now).select(
        "date",
        "zipcode",
        F.col("p.aqius").alias("aqi"),
        F.col("p.p2.conc").alias("pm25_ugm3"),
        F.lit("Unknown").alias("aqi_category"),
    )


def flatten_visits(landed: DataFrame, payload: str = "payload", start=None, end=None) -> DataFrame:
    """Landed (zipcode, payload) with an array of daily counts; a missing count is 0."""
    rows = landed.select("zipcode", F.explode(F.from_json(payload, VISITS_PAYLOAD)).alias("r")).select(
        F.col("r.date").try_cast("date").alias("date"),
        "zipcode",
        F.coalesce(F.col("r.visit_count").try_cast("bigint"), F.lit(0)).cast("bigint").alias("er_visits"),
    )
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
    return rows


def mentions(text: Column, words: Sequence[str]) -> Column:
    """Case-insensitive containment of any word, over the whole text."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(lowered, F.lit(w.lower()))
    return hit


def daily_symptom_rate(posts: DataFrame, words: Sequence[str] = P.SYMPTOM_KEYWORDS) -> DataFrame:
    """Posts (date, text) to one row a day: share of posts with a symptom word, volume, rate."""
    total = F.greatest(F.count("*"), F.lit(1))
    share = F.count_if(mentions(F.col("text"), words)) / total
    return posts.groupBy("date").agg(
        F.round(share, 4).alias("negative_sentiment"),
        total.alias("post_volume"),
        F.round(share * P.MENTION_FACTOR, 4).alias("symptom_mention_rate"),
    )


def search_posts(posts: DataFrame, words: Sequence[str] = P.SEARCH_KEYWORDS, language: str = "en") -> DataFrame:
    return posts.filter((F.col("lang") == language) & mentions(F.col("text"), words))


def flatten_address(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """First address match to a location; no match gives no row."""
    first = F.get(F.from_json(payload, ADDRESS_PAYLOAD)["result"]["addressMatches"], 0)
    return landed.withColumn("m", first).filter("m is not null").select(
        "zipcode",
        F.col("m.coordinates.y").alias("lat"),
        F.col("m.coordinates.x").alias("lon"),
        F.coalesce("m.addressComponents.city", F.lit("")).alias("city"),
        F.coalesce("m.addressComponents.state", F.lit("")).alias("state"),
    )


def flatten_place(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """First place result; city and state are picked by component type."""
    first = F.get(F.from_json(payload, PLACE_PAYLOAD)["results"], 0)

    def named(kind: str, field: str) -> Column:
        hits = F.filter(F.col("m.address_components"), lambda c: F.array_contains(c["types"], kind))
        return F.coalesce(F.try_element_at(hits, F.lit(-1))[field], F.lit(""))

    return landed.withColumn("m", first).filter("m is not null").select(
        "zipcode",
        F.col("m.geometry.location.lat").alias("lat"),
        F.col("m.geometry.location.lng").alias("lon"),
        named("locality", "long_name").alias("city"),
        named("administrative_area_level_1", "short_name").alias("state"),
    )
