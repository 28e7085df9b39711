"""The registry: names, twins, and a sample compared on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("s02_range_filter", "j01_outer_merge", "q01_deduplicate", "e01_clean", "w07_pct_change", "a02_map_summary", "q14_temporal_split")


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 125


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_equals_its_twin(spark, name):
    assert check.compare(entry.queries()[name](spark, FOLDER), check.connect(FOLDER), entry.oracle_sql()[name]).startswith("ok ")


def test_entry_has_one_row_per_region(spark):
    assert entry.entry(spark).count() == 15
