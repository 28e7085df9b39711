"""Merge, cleaning, quality and splits on small frames."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionwatch import params as P
from regionwatch.functions.quantiles import exact_quantiles
from regionwatch.operators import clean, lookup, merge, quality, region
from regionwatch.sources import derived, payloads, sinks, tables
from regionwatch.session import work_folder

D = dt.date


def day(i: int) -> dt.date:
    return D(2023, 1, 1) + dt.timedelta(days=i)


def by_key(df, *columns):
    return {(r["zipcode"], r["date"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_outer_merge_keeps_all_keys_once(spark):
    a = spark.createDataFrame([(day(0), "02101", 1.0), (day(1), "02101", 2.0), (day(1), "02101", 9.0)], "date date, zipcode string, a double")
    b = spark.createDataFrame([(day(1), "02101", 5.0), (day(2), "10001", 6.0)], "date date, zipcode string, b double")
    out = merge.outer_merge({"a": a, "none": None, "b": b})
    assert by_key(out, "a", "b") == {
        ("02101", day(0)): (1.0, None), ("02101", day(1)): (2.0, 5.0), ("10001", day(2)): (None, 6.0),
    }


def test_outer_merge_equals_the_join_fold(spark):
    frames = [
        spark.range(60).select(F.date_add(F.lit(day(0)), (F.col("id") * k % 40).cast("int")).alias("date"),
                               (F.col("id") % 3).cast("string").alias("zipcode"), F.col("id").cast("double").alias(f"v{k}"))
        .dropDuplicates(["date", "zipcode"]) for k in (3, 7, 11)
    ]
    frames = [spark.createDataFrame(f.toPandas(), f.schema) for f in frames]
    fold = frames[0]
    for f in frames[1:]:
        fold = fold.join(f, ["date", "zipcode"], "full")
    out = merge.outer_merge({str(i): f for i, f in enumerate(frames)}, unique=True).select(*fold.columns)
    assert out.exceptAll(fold).isEmpty() and fold.exceptAll(out).isEmpty()


def test_outer_merge_without_sources_is_an_error():
    with pytest.raises(ValueError):
        merge.outer_merge({"a": None})


def test_keep_first_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    out = merge.keep_first(rows, ["k"], ["v"])
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0), (1, 1)]
    plan = merge.keep_first(rows, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2      # before and after the exchange


def test_clean_types_fill_median_and_caps(spark):
    rows = [
        (day(0), "1", None, "5"), (day(1), "1", 600.0, "x"), (day(2), "1", None, "7"), (day(3), "1", float("nan"), "1"),
        (day(0), "2", None, "3"), (day(0), "1", 1.0, "9"),
    ]
    df = spark.createDataFrame(rows, "date date, zipcode string, aqi double, er_visits string")
    out = by_key(clean.clean(df, order=[F.col("er_visits")]), "aqi", "er_visits")
    # region 1: 600 fills both ways and is capped; region 2 has none and takes the median before the cap
    assert out[("1", day(0))] == (500.0, 5.0)
    assert out[("1", day(1))] == (500.0, 5.0)
    assert out[("1", day(3))] == (500.0, 1.0)
    assert out[("2", day(0))] == (500.0, 3.0)


def test_caps_keep_missing_values(spark):
    df = spark.createDataFrame([(None, -1.0), (700.0, 5.0)], "aqi double, pharmacy_sales double")
    assert [tuple(r) for r in clean.cap_to_ranges(df).collect()] == [(None, 0.0), (500.0, 5.0)]


def test_outliers_and_winsorise(spark):
    rows = [(day(i), "1", 10.0 + i % 5) for i in range(60)] + [(day(60), "1", 999_999.0), (day(0), "2", 4.0), (day(1), "2", 4.0)]
    df = spark.createDataFrame(rows, "date date, zipcode string, aqi double")
    flagged = [r for r in clean.flag_outliers(df).collect() if r["aqi_outlier"]]
    assert [r["aqi"] for r in flagged] == [999_999.0]
    assert clean.winsorise(df, ["aqi"]).agg(F.max("aqi")).first()[0] < 999_999.0


@pytest.mark.parametrize("n", [1, 2, 7, 5_000, 20_000])
def test_exact_quantiles_match_the_exact_builtin(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % 10_007 / 13).alias("a"), F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.rand(3)).alias("b"))
    df = df.withColumn("b", F.when(F.col("a") > 1, F.col("b"))).persist()
    probs = [0.01, 0.25, 0.5, 0.99]
    got = {(r["column"], r["probability"]): r["value"] for r in exact_quantiles(df, ["a", "b"], probs).collect()}
    for c in ("a", "b"):
        want = df.agg(F.percentile(c, probs)).first()[0]
        if want is None:
            assert all((c, p) not in got for p in probs)
        else:
            assert [got[(c, p)] for p in probs] == pytest.approx(want, rel=1e-12)


def test_quantiles_of_adversarial_values(spark, monkeypatch):
    from regionwatch.functions import quantiles

    # few values a bracket and a rough sketch: several rounds, and ranks outside the first cuts
    monkeypatch.setattr(quantiles, "FEW", 3)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 30)
    n = F.col("id")
    df = spark.range(900).select(
        F.pow(F.lit(10.0), (n * 7919 % 601 - 300).cast("double")).alias("wide"),
        F.when(n % 10 < 9, 5.0).otherwise(n * 1e-9).alias("tied"),
        F.when(n % 2 == 0, -1e308).when(n % 3 == 0, 1e308).otherwise(-n * 1.0).alias("far"),
        F.lit(7.0).alias("same"),
        F.when(n == 5, 0.0).when(n == 6, -0.0).alias("two"),
        F.lit(None).cast("double").alias("none"),
    )
    probs = [0.0, 0.333, 0.5, 0.95]
    columns = ["wide", "tied", "far", "same", "two", "none"]
    got = {(r["column"], r["probability"]): r["value"] for r in exact_quantiles(df, columns, probs).collect()}
    assert {c for c, _ in got} == set(columns) - {"none"}
    for c in columns[:-1]:
        values = sorted(r[0] for r in df.select(c).dropna().collect())
        for p in probs:
            at = p * (len(values) - 1)
            low, high = values[int(at)], values[-int(-at // 1)]
            assert got[c, p] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12), (c, p)


def test_split_is_ordered_and_disjoint(spark):
    df = spark.range(100).select(F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("date"), F.lit("1").alias("zipcode"))
    train, validation, test = (sorted(r["date"] for r in part.collect()) for part in clean.split(df))
    assert (len(train), len(validation), len(test)) == (70, 15, 15) or (len(train), len(validation)) == (70, 14)
    assert train[-1] < validation[0] and validation[-1] < test[0]


def test_missing_report_counts_nulls_and_nans(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (float("nan"), "b")], "x double, zipcode string")
    got = {r["column"]: (r["count"], r["pct"]) for r in quality.missing_values(df).collect()}
    assert got == {"x": (2, 66.67), "zipcode": (1, 33.33)}


def test_lookup_chain_prefers_the_first_provider(spark):
    keys = spark.createDataFrame([("10001", "old"), ("02101", "old"), ("77777", "old")], "zipcode string, city string")
    first = merge.region_table(spark)
    second = merge.region_table(spark, [("10001", "Wrong", "XX", 0.0, 0.0), *P.STATIC_LOOKUP[-8:], P.STATIC_LOOKUP[18]])
    got = {r["zipcode"]: (r["city"], r["lat"]) for r in lookup.geocode(keys, [first, second]).collect()}
    assert got == {"10001": ("New York", 40.7484), "02101": ("Boston", 42.3601), "77777": ("", None)}
    assert [r["zipcode"] for r in lookup.unresolved(keys, [first, second]).collect()] == ["77777"]


def test_interval_membership_with_overlaps(spark):
    panel = spark.createDataFrame([(day(i), "1") for i in range(6)] + [(day(2), "2")], "date date, zipcode string")
    spans = spark.createDataFrame([("1", day(1), day(3)), ("1", day(2), day(4))], "zipcode string, start date, end date")
    out = by_key(merge.in_any_interval(panel, spans, "hit"), "hit")
    assert [out[("1", day(i))][0] for i in range(6)] == [False, True, True, True, True, False]
    assert out[("2", day(2))] == (False,)


def test_csv_scan_keeps_leading_zeros(spark):
    folder = work_folder(spark, "csv")
    spark.createDataFrame([("2023-01-01", "02101", "7")], "date string, zipcode string, er_visits string").write.option("header", True).csv(folder)
    assert [tuple(r) for r in tables.scan_source(spark, "er_visits", folder, "csv").collect()] == [(day(0), "02101", 7)]


def test_missing_source_is_an_empty_frame(spark):
    out = tables.collect_sources(spark, {})
    assert set(out) == set(tables.SOURCE_SCHEMAS)
    assert out["weather"].isEmpty() and "humidity_pct" in out["weather"].columns


def test_payload_defaults(spark):
    landed = spark.createDataFrame([(day(0), "1", '{"current": {"temp": 3.5, "rain": {"1h": 2}}}'), (day(1), "1", "{}")], "date date, zipcode string, payload string")
    assert [tuple(r)[2:] for r in payloads.flatten_weather(landed).orderBy("date").collect()] == [(3.5, None, 48.0, None), (None, None, 0.0, None)]
    visits = spark.createDataFrame([("1", '[{"date": "2023-01-01", "visit_count": "4"}, {"date": "2023-01-02"}]')], "zipcode string, payload string")
    assert [r["er_visits"] for r in payloads.flatten_visits(visits).orderBy("date").collect()] == [4, 0]


def test_models_are_stored_by_region(spark):
    models = spark.createDataFrame([("02101", 1.0), ("10001", 2.0)], "zipcode string, sigma double")
    path = sinks.save_models(models, work_folder(spark, "models"))
    assert sinks.load_models(spark, path, "02101").first()["sigma"] == 1.0
    with pytest.raises(FileNotFoundError):
        sinks.load_models(spark, path, "99999")


def test_panel_counts_every_line_item(spark):
    folder = "/root/testdata/sf0.001"
    panel = derived.long_panel(spark, folder)
    assert panel.agg(F.sum("post_volume")).first()[0] == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_correlations_with_a_constant_column(spark):
    rows = [("z", 1.0, 2.0, 10.0), ("z", 2.0, 3.0, 10.0), ("z", 3.0, 5.0, 10.0), ("z", None, 9.0, 10.0), ("z", 4.0, None, 7.0)]
    df = spark.createDataFrame(rows, "zipcode string, aqi double, er_visits double, precipitation_mm double")
    got = {r["feature"]: r["abs_corr"] for r in region.target_correlations(df).collect()}
    assert got == {"aqi": pytest.approx(np.corrcoef([1, 2, 3], [2, 3, 5])[0, 1]), "precipitation_mm": None}
    matrix = {(r["a"], r["b"]): r["corr"] for r in region.correlation_matrix(df.withColumn("aqi", F.lit(4.0)), columns=["aqi", "er_visits"]).collect()}
    assert matrix["aqi", "er_visits"] is None and matrix["aqi", "aqi"] is None and matrix["er_visits", "er_visits"] == pytest.approx(1)
