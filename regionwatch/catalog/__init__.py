"""Named queries over a data folder, with their SQL twins."""

from __future__ import annotations


def _load():
    from . import base, feature_queries, forecast_queries, hotspot_queries, io_queries, panel_queries  # noqa: F401

    return base


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_load().ORACLES)
