"""Time audits: missing date filters, unbounded scans, naive timestamps, month totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainguard.plans.shapes import ratio, total


def naive(text: str) -> Column:
    """Timestamp literal without a time zone."""
    return F.to_timestamp_ntz(F.lit(text))


def days_before(ts: Column, days: int) -> Column:
    return ts - F.expr(f"INTERVAL {int(days)} DAYS")


def missing_time_filter(df: DataFrame, keep: Column, ts: str, measure: str, days: int, as_of: str) -> DataFrame:
    """All-time COUNT and SUM under a non-date filter against the last ``days`` before ``as_of``."""
    recent = (F.col(ts) >= days_before(naive(as_of), days)) & (F.col(ts) <= naive(as_of))
    sums = df.where(keep).agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(recent).alias("window_rows"),
        total(measure).alias("all_sum"),
        total(F.when(recent, F.col(measure))).alias("window_sum"),
    )
    return sums.withColumn("share_outside", 1 - ratio("window_rows", "all_rows")).withColumn(
        "sum_share_outside", 1 - ratio("window_sum", "all_sum")
    )


def bare_scan_growth(df: DataFrame, ts: str, as_of: str) -> DataFrame:
    """Rows per month, their running total, and the share a 30-day filter would have read.

    The running sum has no partition, but runs over one row per month.
    """
    start = days_before(naive(as_of), 30)
    recent = (F.col(ts) >= start) & (F.col(ts) <= naive(as_of))
    months = df.groupBy(F.trunc(F.col(ts).cast("date"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(recent).alias("recent_rows")
    )
    upto = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return months.select(
        "month",
        "rows",
        F.sum("rows").over(upto).alias("cumulative_rows"),
        ratio(F.sum("recent_rows").over(everything), F.sum("rows").over(everything)).alias("filtered_share"),
    )


def timezone_shift(df: DataFrame, ts: str, offset_hours: Sequence[int], cutoff: str) -> DataFrame:
    """Rows whose day, or side of a cutoff, changes when a naive timestamp is read under another offset.

    All offsets are counted in one scan.
    """
    t = F.col(ts)
    edge = naive(cutoff)
    shifted = {h: t + F.expr(f"INTERVAL {int(h)} HOURS") for h in offset_hours}
    sums = df.agg(
        F.count(t).alias("n"),
        *[F.count_if(s.cast("date") != t.cast("date")).alias(f"day_{i}") for i, s in enumerate(shifted.values())],
        *[F.count_if((s >= edge) != (t >= edge)).alias(f"cut_{i}") for i, s in enumerate(shifted.values())],
    )
    rows = [
        F.struct(
            F.lit(int(h)).alias("offset_hours"),
            F.col("n").alias("rows"),
            F.col(f"day_{i}").alias("day_changed"),
            F.col(f"cut_{i}").alias("cutoff_changed"),
        )
        for i, h in enumerate(offset_hours)
    ]
    return sums.select(F.inline(F.array(*rows)))


def month_rollup(df: DataFrame, ts: str, measure: str, by: Sequence[str]) -> DataFrame:
    """SUM and COUNT per month with a "Mon YYYY" label.

    The label comes from the date's own text, never from a shift into local time.
    """
    month = F.trunc(F.col(ts).cast("date"), "month")
    return (
        df.groupBy(month.alias("month"), *by)
        .agg(F.sum(measure).alias("revenue"), F.count(F.lit(1)).alias("rows"))
        .withColumn("label", F.date_format("month", "MMM yyyy"))
    )
