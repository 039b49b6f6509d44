"""Rounding and ratios with one fixed rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Round half towards plus infinity: floor(x + 0.5). Spark's round() sends -2.5 to -3, this one to -2."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent of ``part`` in ``whole``; 0 when ``whole`` is 0."""
    return F.when(whole == 0, F.lit(0)).otherwise(half_up(part / F.nullif(whole, F.lit(0)) * 100)).cast("bigint")


def rounded_mean(total: Column, n: Column) -> Column:
    """Mean rounded to a whole number; 0 on no rows."""
    return F.when(n == 0, F.lit(0)).otherwise(half_up(total / F.nullif(n, F.lit(0)))).cast("bigint")
