"""Merging keyed sources into one panel, and dimension joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import params as P

REGION_COLUMNS = ("zipcode", "city", "state", "lat", "lon")


def keep_first(df: DataFrame, keys: Sequence[str] = P.KEYS, order: Sequence = ()) -> DataFrame:
    """One row per key, the first in a declared total order.

    ``row_number() = 1`` is limited on the map side before the shuffle, so a key
    with very many copies sends one row per input task.
    """
    by = list(order) or [c for c in df.columns if c not in keys]
    first = W.partitionBy(*keys).orderBy(*(by or list(keys)))
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def outer_merge(sources: Mapping[str, DataFrame | None], keys: Sequence[str] = P.KEYS, unique: bool = False) -> DataFrame:
    """Full outer merge of any number of sources on the keys, in one grouping.

    Sources are stacked by name and grouped once instead of folding joins, which
    would shuffle again after every coalesced key. ``unique=True`` says that every
    source already has one row per key; otherwise the first row per key is kept.
    A source given as None is left out.
    """
    frames = [df for df in sources.values() if df is not None]
    if not frames:
        raise ValueError("no source to merge")
    normal = [
        df.withColumns({"date": F.col("date").cast("date"), "zipcode": F.col("zipcode").cast("string")})
        for df in frames
    ]
    if not unique:
        normal = [keep_first(df, keys) for df in normal]
    values = list(dict.fromkeys(c for df in normal for c in df.columns if c not in keys))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), normal)
    # at most one non-null value per key and column, so ``first`` has nothing to choose from
    return stacked.groupBy(*keys).agg(*[F.expr(f"first(`{c}`, true) AS `{c}`") for c in values])


def inner_merge(sources: Sequence[DataFrame], keys: Sequence[str] = P.KEYS) -> DataFrame:
    """Keys present in every source."""
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), sources)


def region_table(spark: SparkSession, rows: Sequence[tuple] = P.REGIONS) -> DataFrame:
    """Literal rows as an inline table: its size is known to the planner."""
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    values = ", ".join(
        f"({quote(z)}, {quote(city)}, {quote(state)}, {float(lat)!r}D, {float(lon)!r}D)" for z, city, state, lat, lon in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS r({', '.join(REGION_COLUMNS)})")


def attach_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Left join of the region dimension; columns it would repeat are dropped first.

    The join strategy is left to Spark, which broadcasts the dimension when its
    measured size is under the session's broadcast limit.
    """
    repeated = [c for c in regions.columns if c != "zipcode" and c in df.columns]
    return df.drop(*repeated).join(regions, "zipcode", "left")


def lookup_with_default(df: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Left join on the key; unmatched rows get the default."""
    pairs = table.select(key, F.col(value).alias("_found"))
    base = df.drop(value) if value in df.columns else df
    return base.join(pairs, key, "left").withColumn(value, F.coalesce("_found", F.lit(default))).drop("_found")


def in_any_interval(df: DataFrame, intervals: DataFrame, output: str) -> DataFrame:
    """Flag days inside any [start, end] of the row's region.

    Intervals become days and meet the panel in an equi-join; overlapping
    intervals collapse before the join.
    """
    days = (
        intervals.select("zipcode", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("date"))
        .distinct()
        .withColumn("_inside", F.lit(True))
    )
    return df.join(days, ["zipcode", "date"], "left").withColumn(output, F.coalesce("_inside", F.lit(False))).drop("_inside")


def copy_to_regions(daily: DataFrame, zipcodes: Sequence[str]) -> DataFrame:
    """Every row once per requested region, as an expansion of a literal list."""
    return daily.withColumn("zipcode", F.explode(F.array(*[F.lit(str(z)) for z in zipcodes])))
