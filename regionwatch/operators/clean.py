"""Typing, de-duplication, imputation, capping, outliers and temporal splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import params as P
from ..functions import windows
from ..functions.guards import clip, numeric_columns, one_row, present, with_statistics
from ..functions.quantiles import with_quantiles
from ..session import reuse
from .merge import keep_first

SPLITS = ("train", "validation", "test")


def fix_types(df: DataFrame, numeric: Sequence[str] = P.NUMERIC_COLUMNS) -> DataFrame:
    """Date and key typed, numbers coerced; unparsable values and NaN become null."""
    new: dict[str, Column] = {
        "date": F.col("date").try_cast("date") if "date" in df.columns else F.lit(None),
        "zipcode": F.col("zipcode").cast("string"),
    }
    for c in present(df, numeric):
        new[c] = F.expr(f"nullif(try_cast(`{c}` AS DOUBLE), double('NaN'))")
    return df.withColumns(new)


def fill_with_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's exact median over the whole frame."""
    columns = present(df, columns)
    base, medians = with_quantiles(df, columns, [0.5])
    return base.withColumns({c: F.coalesce(F.col(c), medians[(c, 0.5)]) for c in columns}).select(*df.columns)


def impute(df: DataFrame, columns: Sequence[str] = P.NUMERIC_COLUMNS) -> DataFrame:
    """Fill within the region, then with the median of the filled column."""
    columns = present(df, columns)
    filled = reuse(windows.fill_within_region(df, columns))  # read by the medians and by the result
    return fill_with_median(filled, columns)


def cap_to_ranges(df: DataFrame, ranges: Mapping[str, tuple] = P.PHYSICAL_RANGES) -> DataFrame:
    bound = lambda v, f, text: text if v is None else f"{f}({text}, {float(v)!r}D)"
    text = lambda c, lo, hi: bound(hi, "least", bound(lo, "greatest", f"`{c}`"))
    return df.withColumns(
        {
            c: F.expr(f"CASE WHEN `{c}` IS NOT NULL THEN {text(c, lo, hi)} END")
            for c, (lo, hi) in ranges.items() if c in df.columns
        }
    )


def clean(df: DataFrame, order: Sequence = (), unique: bool = False) -> DataFrame:
    """De-duplicate, type, impute and cap. ``unique=True`` skips the de-duplication
    of a panel that a merge already keyed."""
    one_per_key = df if unique else keep_first(df, P.KEYS, order)
    return cap_to_ranges(impute(fix_types(one_per_key)))


def drop_missing_target(df: DataFrame, target: str = P.TARGET) -> DataFrame:
    return df.na.drop(subset=[target])


def region_zscore(column: str) -> Column:
    """Population z-score within the region; a constant region gives null."""
    w = windows.whole()
    spread = F.when(F.max(column).over(w) > F.min(column).over(w), F.stddev_pop(column).over(w))
    return (F.col(column) - F.avg(column).over(w)) / spread


def flag_outliers(df: DataFrame, columns: Sequence[str] = P.ANOMALY_COLUMNS, threshold: float = P.ANOMALY_THRESHOLD) -> DataFrame:
    """Boolean ``{c}_outlier``: absolute z-score above the threshold."""
    return df.withColumns(
        {
            f"{c}_outlier": F.coalesce(F.abs(region_zscore(c)) > threshold, F.lit(False))
            for c in present(df, columns)
        }
    )


def winsorise(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip columns to their global low and high quantiles."""
    columns = present(df, columns)
    base, q = with_quantiles(df, columns, [low, high])
    return base.withColumns({c: clip(F.col(c), q[(c, low)], q[(c, high)]) for c in columns}).select(*df.columns)


def fill_with_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and NaN become the column mean; output as float."""
    columns = present(df, columns)
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    base = with_statistics(df, df, "_mean", **{c: F.avg(number[c]) for c in columns})
    return base.withColumns({c: F.coalesce(number[c], F.col(f"_mean.{c}")).cast("float") for c in columns}).select(*df.columns)


def split_cutoffs(df: DataFrame, train: float = 0.70, validation: float = 0.15) -> Column:
    """Two cut dates at fixed positions of the sorted distinct dates.

    The collected set is one element per calendar day.
    """
    days = F.sort_array(F.collect_set("date"))
    n = F.size(days)
    at = lambda share: F.element_at(days, (F.floor(n * F.lit(share)) + 1).cast("int"))
    return one_row(df, validation_from=at(train), test_from=at(train + validation))


def label_split(df: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Add ``split``: train before the first cutoff, validation before the second, test after."""
    cut = F.col("_cut")
    label = (
        F.when(F.col("date") < cut["validation_from"], SPLITS[0])
        .when(F.col("date") < cut["test_from"], SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return df.withColumn("_cut", split_cutoffs(df, train, validation)).withColumn("split", label).drop("_cut")


def split(df: DataFrame, train: float = 0.70, validation: float = 0.15) -> tuple[DataFrame, DataFrame, DataFrame]:
    labelled = label_split(df, train, validation)
    return tuple(labelled.filter(F.col("split") == s).drop("split") for s in SPLITS)


def feature_names(df: DataFrame, target: str = P.TARGET) -> list[str]:
    """Numeric columns that are neither keys, names, the target nor outlier flags."""
    return [
        c for c in numeric_columns(df)
        if c not in P.NON_FEATURES and c != target and not c.endswith("_outlier")
    ]


def select_features(df: DataFrame, target: str = P.TARGET) -> DataFrame:
    return df.select(*P.KEYS, *feature_names(df, target), target)


def priority_features(df: DataFrame, names: Sequence[str] = P.PRIORITY_FEATURES) -> DataFrame:
    return df.select(*P.KEYS, *present(df, names))
