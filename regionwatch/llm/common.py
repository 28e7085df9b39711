"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import work_folder

#: A key is hot if it holds over 1 / HOT_SHARE of the rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 256

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder: later jobs read it there, whatever executors are lost."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join with a side that has one row a key, where left may hold a third of its rows under one key.

    ``weight`` is right's count of left rows per key and ``total`` their sum, so at most HOT_SHARE keys are
    hot: these few rows are broadcast, all other keys meet by shuffle. Both frames are read twice and should
    be cheap to read. Rows of left with a null key find no partner.
    """
    hot = right.where(F.col(weight) * HOT_SHARE > total).drop(weight)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.drop(weight), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space; null is empty."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that a task holds few texts as Python objects at a time.

    A worker outlives its tasks: what Arrow's pool has spare at the end goes back, else each worker keeps its peak.
    """
    batch = None
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        del batch
        pa.default_memory_pool().release_unused()


#: Elements whose sums are made one after the other; sums of so many such stretches likewise.
STRETCH = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column) -> Column:
    """Running sums, each inclusive; the work is the square of the length."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(values, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))


def _prefix_sums(values: Column) -> Column:
    stretches = F.when(F.size(values) > 0, F.sequence(F.lit(0), ((F.size(values) - 1) / STRETCH).cast("int"))).otherwise(F.array().cast("array<int>"))
    return bound(F.transform(stretches, lambda k: _running(F.slice(values, k * STRETCH + 1, STRETCH))), _joined)


def _joined(sums: Column) -> Column:
    """The running sums of all stretches in a row, from those of each."""
    tops = _running(F.transform(sums, lambda s: F.get(s, F.size(s) - 1)))
    both = F.arrays_zip(sums.alias("s"), tops.alias("t"))
    return F.flatten(F.transform(both, lambda z: bound(z["t"] - F.get(z["s"], F.size(z["s"]) - 1), lambda before: F.transform(z["s"], lambda x: x + before))))


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of longs, in stretches so that long arrays stay cheap."""
    return bound(values, _prefix_sums)
