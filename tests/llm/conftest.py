"""Frames of the odd rows, with columns named as the operators name theirs."""

import pytest
from pyspark.sql import functions as F

from odd_rows import CLASHES, ROWS


def odd_documents(spark, rows=ROWS):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
