"""Table, report, map and model sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.hotspots import map_features, metadata


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), kind: str = "parquet", mode: str = "overwrite") -> str:
    """One write for all regions. With partition columns, rows are first brought
    together by them, so that a region gets few files rather than one per task."""
    if partition_by:
        df = df.repartition(*partition_by)
    df.write.mode(mode).partitionBy(*partition_by).format(kind).save(path)
    return path


def write_forecasts(forecast: DataFrame, path: str) -> str:
    """Forecast rows partitioned by region, for pruned reads of one region."""
    return write_table(forecast, path, ("zipcode",))


def write_reports(reports: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> dict[str, str]:
    """Report tables as JSON lines, and a one-row summary of what was written."""
    spark = next(iter(reports.values())).sparkSession
    outputs = {}
    for name, df in reports.items():
        outputs[name] = f"{path}/{name}"
        df.write.mode(mode).json(outputs[name])
    summary = spark.range(1).select(
        F.current_timestamp().alias("run_timestamp"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in outputs]), F.array(*[F.lit(v) for v in outputs.values()])).alias("outputs"),
    )
    summary.write.mode(mode).json(f"{path}/run_summary")
    return {**outputs, "run_summary": f"{path}/run_summary"}


def write_map(labelled: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Map features as JSON lines, one feature a line: the form for any number of regions."""
    map_features(labelled).select(F.to_json("feature").alias("value")).write.mode(mode).text(path)
    return path


def map_document(labelled: DataFrame) -> DataFrame:
    """Lines (part, zipcode, value) that make one FeatureCollection document when put in order of part and zipcode.

    The head holds the metadata, every region is one line, and no row holds more than one feature.
    """
    about = metadata(labelled).select(
        F.struct("n_regions", "n_clusters", F.struct("High", "Medium", "Low").alias("risk_distribution")).alias("m")
    )
    no_key = F.lit(None).cast("string").alias("zipcode")
    head = F.concat(F.lit('{"type":"FeatureCollection","metadata":'), F.to_json("m"), F.lit(',"features":['))
    features = map_features(labelled)
    first = features.agg(F.min("zipcode").alias("z")).scalar()
    comma = F.when(F.col("zipcode") == first, "").otherwise(",")
    lines = features.select(F.lit(1).alias("part"), "zipcode", F.concat(comma, F.to_json("feature")).alias("value"))
    tail = labelled.sparkSession.range(1).select(F.lit(2).alias("part"), no_key, F.lit("]}").alias("value"))
    return about.select(F.lit(0).alias("part"), no_key, head.alias("value")).unionByName(lines).unionByName(tail)


def write_map_document(labelled: DataFrame, path: str, mode: str = "overwrite") -> str:
    """The document in files that follow each other by name: sorted by ranges, so by as many tasks as there are ranges."""
    map_document(labelled).orderBy("part", "zipcode").select("value").write.mode(mode).text(path)
    return path


def save_models(models: DataFrame, path: str, note: str = "") -> str:
    """Model rows by region, with the time they were saved and a note."""
    stamped = models.withColumns({"saved_at": F.current_timestamp(), "note": F.lit(note)})
    return write_table(stamped, path, ("zipcode",))


def load_models(spark: SparkSession, path: str, zipcode: str | None = None) -> DataFrame:
    """All models, or one region's by partition pruning; a missing region is an error."""
    # the partition column is declared, so that keys keep their leading zeros
    schema = spark.read.option("recursiveFileLookup", True).parquet(path).schema
    models = spark.read.schema(schema.add("zipcode", "string")).parquet(path)
    if zipcode is None:
        return models
    one = models.filter(F.col("zipcode") == str(zipcode))
    if one.isEmpty():
        raise FileNotFoundError(f"no model for region {zipcode} under {path}")
    return one
