"""Prioritised location lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import params as P


def resolve(keys: DataFrame, providers: Sequence[DataFrame], key: str = "zipcode") -> DataFrame:
    """One row per distinct key with the location of the first provider that knows it.

    Unresolved keys keep null coordinates and empty names.
    """
    columns = [key, "lat", "lon", "city", "state"]
    ranked = None
    for rank, table in enumerate(providers):
        part = table.select(*[F.col(c).cast("string").alias(c) if c == key else c for c in columns]).withColumn(
            "_rank", F.lit(rank)
        )
        ranked = part if ranked is None else ranked.unionByName(part)
    # smallest struct = best provider; its later fields break ties inside one provider
    best = ranked.groupBy(key).agg(F.min(F.struct("_rank", "lat", "lon", "city", "state")).alias("b"))
    distinct = keys.select(F.col(key).cast("string").alias(key)).distinct()
    return distinct.join(best, key, "left").select(
        key,
        F.col("b.lat").alias("lat"),
        F.col("b.lon").alias("lon"),
        F.coalesce("b.city", F.lit("")).alias("city"),
        F.coalesce("b.state", F.lit("")).alias("state"),
    )


def geocode(df: DataFrame, providers: Sequence[DataFrame], key: str = "zipcode") -> DataFrame:
    """Attach lat, lon, city and state, replacing columns of these names."""
    located = resolve(df, providers, key)
    base = df.drop(*P.DIMENSION_COLUMNS).withColumn(key, F.col(key).cast("string"))
    return base.join(located, key, "left")


def unresolved(df: DataFrame, providers: Sequence[DataFrame], key: str = "zipcode") -> DataFrame:
    """Rows whose key no provider knows, by anti join against the known keys."""
    known = None
    for table in providers:
        part = table.filter(F.col("lat").isNotNull()).select(F.col(key).cast("string").alias(key))
        known = part if known is None else known.union(part)
    return df.withColumn(key, F.col(key).cast("string")).join(known.distinct(), key, "left_anti")
