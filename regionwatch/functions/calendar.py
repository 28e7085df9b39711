"""Calendar, season and cyclical expressions over a date column."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def season(month: Column) -> Column:
    """1 winter (Dec-Feb), 2 spring, 3 summer, 4 fall."""
    return (F.floor((month % 12) / 3) + 1).cast("int")


def calendar_columns(date: str = "date") -> dict[str, Column]:
    d = F.col(date)
    dow, month = F.weekday(d), F.month(d)
    turn = 2 * math.pi
    return {
        "day_of_week": dow,
        "day_of_year": F.dayofyear(d),
        "month": month,
        "week_of_year": F.weekofyear(d),
        "year": F.year(d),
        "quarter": F.quarter(d),
        "is_weekend": (dow >= 5).cast("int"),
        "season": season(month),
        "dow_sin": F.sin(turn * dow / 7),
        "dow_cos": F.cos(turn * dow / 7),
        "month_sin": F.sin(turn * month / 12),
        "month_cos": F.cos(turn * month / 12),
    }


def seasonal_signal(date: Column, amplitude: float, phase: float = 0.0, period: float = 365.0) -> Column:
    """amplitude * cos(2 pi (day of year - phase) / period)."""
    return F.lit(float(amplitude)) * F.cos(F.lit(2 * math.pi) * (F.dayofyear(date) - F.lit(float(phase))) / F.lit(float(period)))
