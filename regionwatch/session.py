"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "regionwatch") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # as many partitions as cores already; merging small ones would idle cores on window work
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local-mode session without the setting gets a folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="regionwatch-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


_scopes: list[list[DataFrame]] = []


def reuse(df: DataFrame) -> DataFrame:
    """Keep a frame that several branches of one job read.

    Used on aggregated panels only; lost blocks are recomputed from the sources. Inside ``released`` it is kept until
    the end of that block, else until its caller lets it go.
    """
    if df.storageLevel != StorageLevel.NONE:
        return df
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _scopes:
        _scopes[-1].append(kept)
    return kept


@contextmanager
def released() -> Iterator[None]:
    """Lets go, at its end, of the frames that ``reuse`` kept inside it; for jobs that write all they return."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            df.unpersist()
