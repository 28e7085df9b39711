"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import clean, features, merge, quality
from ..session import reuse


@dataclass(frozen=True)
class Preprocessed:
    """Lazy outputs of the preprocess job."""

    panel: DataFrame
    train: DataFrame
    validation: DataFrame
    test: DataFrame
    report: DataFrame


def clean_panel(merged: DataFrame) -> DataFrame:
    """Cleaning job over a panel that the merge already keyed."""
    return clean.clean(merged, unique=True)


def preprocess(
    sources: Mapping[str, DataFrame | None], regions: DataFrame | None = None, unique: bool = False
) -> Preprocessed:
    """Merge, clean, flag outliers, split by date and report; nothing runs yet."""
    panel = merge.outer_merge(sources, unique=unique)
    if regions is not None:
        panel = merge.attach_regions(panel, regions)
    panel = reuse(clean.flag_outliers(clean_panel(panel)))
    train, validation, test = clean.split(panel)
    return Preprocessed(panel, train, validation, test, quality.report(panel))


def feature_job(panel: DataFrame, imputed: bool = True, **options) -> DataFrame:
    """Feature panel; options as of ``features.FeatureOptions``."""
    return features.feature_panel(panel, imputed, features.FeatureOptions(**options))
