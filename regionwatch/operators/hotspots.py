"""Hotspots: weighted region features, density clusters, risk levels, map features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import params as P
from ..functions.guards import present, with_statistics
from ..functions.scores import risk_color, risk_level
from ..session import cut_lineage
from . import density, hierarchy
from .components import components as connected, lookup


def feature_matrix(regions: DataFrame, geo_weight: float = P.GEO_WEIGHT, columns: Sequence[str] = P.CLUSTER_COLUMNS) -> DataFrame:
    """(zipcode, x): weighted normalised coordinates, then normalised signals.

    Coordinates use the sample deviation, signals the population deviation. Regions
    without coordinates have no vector.
    """
    geo = [c for c in ("lat", "lon") if {"lat", "lon"} <= set(regions.columns)]
    signals = present(regions, columns)
    if not geo and not signals:
        raise ValueError("no columns to cluster on")
    signal = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    base = with_statistics(
        regions, regions, "_s",
        **{f"{c}_m": F.avg(c) for c in geo}, **{f"{c}_d": F.stddev_samp(c) for c in geo},
        **{f"{c}_m": F.avg(signal(c)) for c in signals}, **{f"{c}_d": F.stddev_pop(signal(c)) for c in signals},
    )
    normal = lambda v, c: (v - F.col(f"_s.{c}_m")) / (F.col(f"_s.{c}_d") + P.STD_EPSILON)
    parts = [normal(F.col(c), c) * geo_weight for c in geo] + [normal(signal(c), c) for c in signals]
    out = base.select("zipcode", F.array(*parts).alias("x"))
    return out.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


@dataclass
class Density:
    """Distinct points with core distances, their blocks, and which region has which point."""

    points: DataFrame
    boxes: density.Boxes
    members: DataFrame


def measure(matrix: DataFrame, min_samples: int = P.MIN_SAMPLES, block_size: int = density.BLOCK_SIZE) -> Density:
    """Core distance of every region. The matrix is written once, so that later steps
    see the very same coordinates."""
    matrix = cut_lineage(matrix)
    points = density.distinct_points(matrix)
    blocked = cut_lineage(density.with_blocks(points, points.count(), block_size))
    boxes = density.Boxes.of(blocked)
    cored = cut_lineage(density.core_distances(blocked, boxes, min_samples))
    members = matrix.join(cored.select("x", "id", "core"), "x").select("zipcode", "id", "core")
    return Density(cored, boxes, members)


def core_distances(matrix: DataFrame, min_samples: int = P.MIN_SAMPLES) -> DataFrame:
    return measure(matrix, min_samples).members.select("zipcode", "core")


def with_copies(tree: DataFrame, members: DataFrame) -> DataFrame:
    """The tree over regions: copies of a point hang on it at its core distance."""
    extra = members.filter("zipcode <> id").select(F.col("id").alias("a"), F.col("zipcode").alias("b"), F.col("core").alias("w"))
    return tree.unionByName(extra)


def tree_of(found: Density, finish: int = density.FINISH_EDGES) -> DataFrame:
    return with_copies(density.spanning_tree(found.points, found.boxes, finish), found.members)


def spanning_tree(
    matrix: DataFrame,
    min_samples: int = P.MIN_SAMPLES,
    block_size: int = density.BLOCK_SIZE,
    finish: int = density.FINISH_EDGES,
) -> DataFrame:
    """n - 1 mutual reachability edges (a, b, w) over the regions."""
    return tree_of(measure(matrix, min_samples, block_size), finish)


def lightest_links(tree: DataFrame) -> DataFrame:
    """Every region's cheapest mutual reachability edge, which any spanning tree holds."""
    ends = tree.select(F.col("a").alias("zipcode"), "w").union(tree.select("b", "w"))
    return ends.groupBy("zipcode").agg(F.min("w").alias("w"))


def components(
    tree: DataFrame,
    regions: DataFrame,
    epsilon: float = P.CLUSTER_EPSILON,
    min_size: int = P.MIN_CLUSTER_SIZE,
) -> DataFrame:
    """Density components at one distance: regions linked by tree edges up to epsilon.

    Components smaller than ``min_size`` are noise (-1); the others are named by their smallest key.
    """
    labels = cut_lineage(connected(tree.filter(F.col("w") <= epsilon).select(F.lit(0).alias("node"), "a", "b")))
    # a label is its component's smallest key, so a hot one needs no join to find its name
    large = labels.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).drop("n")
    placed = lookup(labels, large.withColumn("_large", F.lit(True)), ["label"], "inner").select(F.col("v").alias("zipcode"), named("label").alias("_id"))
    return regions.select("zipcode").join(placed, "zipcode", "left").select(
        "zipcode", F.coalesce("_id", F.lit(-1)).cast("bigint").alias("cluster_id")
    )


def named(key: str) -> Column:
    """A cluster's number by its smallest key: the key's number, or its hash where keys are no numbers."""
    return F.coalesce(F.col(key).try_cast("bigint"), F.xxhash64(key))


def memberships(
    matrix: DataFrame,
    min_size: int = P.MIN_CLUSTER_SIZE,
    min_samples: int = P.MIN_SAMPLES,
    epsilon: float = P.CLUSTER_EPSILON,
) -> DataFrame:
    """(zipcode, cluster_id, cluster_probability) of every region with a vector, by the cluster hierarchy.

    Clusters are those of the greatest excess of mass; one that begins below epsilon gives way to the first above it
    that does not. They are named by their smallest key. Noise has probability 0.
    """
    found = measure(matrix, min_samples)
    labels = cut_lineage(hierarchy.labels(tree_of(found), max(2, min_size), epsilon))
    first = labels.groupBy("cluster").agg(F.min("point").alias("_first")).select("cluster", named("_first").alias("_id"))
    placed = lookup(labels, first, ["cluster"], "inner").select(F.col("point").alias("zipcode"), "_id", "probability")
    return found.members.select("zipcode").join(placed, "zipcode", "left").select(
        "zipcode", F.coalesce("_id", F.lit(-1)).cast("bigint").alias("cluster_id"), F.coalesce("probability", F.lit(0.0)).alias("cluster_probability")
    )


def memberships_at_distance(
    matrix: DataFrame,
    min_size: int = P.MIN_CLUSTER_SIZE,
    min_samples: int = P.MIN_SAMPLES,
    epsilon: float = P.CLUSTER_EPSILON,
) -> DataFrame:
    """The same for the density components at one distance.

    The probability is the smallest core distance of the region's cluster over its own: 1 in the densest place, 0 for
    noise.
    """
    found = measure(matrix, min_samples)
    labels = components(tree_of(found), found.members, epsilon, min_size).join(found.members.select("zipcode", "core"), "zipcode")
    labels = cut_lineage(labels)
    densest = labels.filter("cluster_id <> -1").groupBy("cluster_id").agg(F.min("core").alias("_least"))
    share = F.when(F.col("core") > 0, F.col("_least") / F.col("core")).otherwise(1.0)
    return labels.join(densest, "cluster_id", "left").select(
        "zipcode", "cluster_id", F.when(F.col("cluster_id") == -1, 0.0).otherwise(share).alias("cluster_probability")
    )


# --- labels and risk ----------------------------------------------------------------


def with_risk(labelled: DataFrame) -> DataFrame:
    """Noise is Low; a cluster member follows its score, or is Medium without one."""
    inside: Column = F.lit("Medium")
    if "disease_risk_score" in labelled.columns:
        inside = risk_level(F.col("disease_risk_score"))
    level = F.when(F.col("cluster_id") == -1, "Low").otherwise(inside)
    return labelled.withColumn("risk_level", level).withColumn("risk_color", risk_color(F.col("risk_level")))


def detect(
    regions: DataFrame,
    min_size: int = P.MIN_CLUSTER_SIZE,
    min_samples: int = P.MIN_SAMPLES,
    epsilon: float = P.CLUSTER_EPSILON,
    geo_weight: float = P.GEO_WEIGHT,
    method: str = "hierarchy",
) -> DataFrame:
    """Snapshot rows with cluster_id, cluster_probability, risk_level and risk_color.

    ``method`` is "hierarchy" or "distance", which takes the density components at epsilon.
    """
    found = {"hierarchy": memberships, "distance": memberships_at_distance}[method]
    regions = cut_lineage(regions)
    matrix = feature_matrix(regions, geo_weight)
    n = matrix.count()
    if n < max(min_size, min_samples + 1):
        flat = regions.withColumns({"cluster_id": F.lit(-1).cast("bigint"), "cluster_probability": F.lit(0.0)})
        return with_risk(flat)
    labelled = regions.join(found(matrix, min_size, min_samples, epsilon), "zipcode", "left").withColumns(
        {
            "cluster_id": F.coalesce("cluster_id", F.lit(-1).cast("bigint")),
            "cluster_probability": F.coalesce("cluster_probability", F.lit(0.0)),
        }
    )
    return with_risk(labelled)


# --- summaries and map features -------------------------------------------------------


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """Size and risk levels of every cluster, noise as -1."""
    counts = labelled.groupBy("cluster_id").pivot("risk_level", list(P.RISK_LEVELS)).count().na.fill(0)
    total = sum((F.col(level) for level in P.RISK_LEVELS), F.lit(0))
    return counts.withColumn("n_regions", total)


def metadata(labelled: DataFrame) -> DataFrame:
    """Regions, clusters without noise, and counts by level, of the rows a map can show."""
    shown = labelled.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return shown.agg(
        F.count("*").alias("n_regions"),
        F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("n_clusters"),
        *[F.count_if(F.col("risk_level") == level).alias(level) for level in P.RISK_LEVELS],
    )


def map_features(labelled: DataFrame) -> DataFrame:
    """One Point feature per located region: zipcode and the ``feature`` struct."""
    have = set(labelled.columns)
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in have else F.lit(d)
    number = lambda c, k: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0), k)
    properties = F.struct(
        text("zipcode").alias("zipcode"),
        text("city").alias("city"),
        text("state").alias("state"),
        F.coalesce(F.col("cluster_id").cast("bigint"), F.lit(-1)).alias("cluster_id") if "cluster_id" in have else F.lit(-1).alias("cluster_id"),
        text("risk_level", "Unknown").alias("risk_level"),
        text("risk_color", P.UNKNOWN_COLOR).alias("risk_color"),
        number("disease_risk_score", 4).alias("disease_risk_score"),
        number("er_visits", 2).alias("er_visits_mean"),
        number("pharmacy_sales", 2).alias("pharmacy_sales_mean"),
        number("negative_sentiment", 4).alias("negative_sentiment_mean"),
        number("aqi", 1).alias("aqi_mean"),
        number("cluster_probability", 4).alias("cluster_probability"),
    )
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))
    return labelled.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("zipcode", feature.alias("feature"))
