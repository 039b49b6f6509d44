"""Running usage, de-duplication, digests, alerts and scores.

What these jobs keep can be added up, so they hold no state: each micro-batch is reduced to its own partial result
(``stream_*``), parts are merged level by level (``levels``; by ``added_up`` or ``keys_of``), and the few that are left
are folded when they are read (``*_of``). Rows may come in any order and as late as they like; none is dropped, and
memory is that of one micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.functions.numbers import rounded_mean
from grainguard.functions.severity import score, severity_counts
from grainguard.operators.governance import route_alerts
from grainguard.plans.shapes import total


def event_time(column: str) -> Column:
    return F.col(column).cast("timestamp")


def added_up(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of a job as one part: every column that is no key is a sum."""
    sums = [F.sum(c).cast(t).alias(c) for c, t in parts.dtypes if c not in keys]
    return parts.groupBy(*keys).agg(*sums).select(*parts.columns)


def stream_usage(batch: DataFrame, ts: str = "created_at") -> DataFrame:
    """Runs per user and day of one micro-batch."""
    day = F.to_date(event_time(ts)).alias("day")
    return batch.groupBy("user_id", day).agg(F.count(F.lit(1)).alias("runs"))


def usage_by_month(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id", F.trunc("day", "month").alias("month")).agg(F.sum("runs").alias("runs"))


def stream_dedup(batch: DataFrame, key: str) -> DataFrame:
    """The delivery keys of one micro-batch, each once."""
    return batch.select(key).distinct()


def keys_of(parts: DataFrame) -> DataFrame:
    """Each key once, however many batches it came in."""
    return parts.distinct()


def stream_digest(batch: DataFrame, window: str = "7 days", slide: str | None = None, ts: str = "created_at") -> DataFrame:
    """Runs, runs with errors and score total per user and window of one micro-batch, tumbling or sliding."""
    return (
        batch.withColumn(ts, event_time(ts))
        .groupBy("user_id", F.window(ts, window, slide or window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(F.col("error_count") > 0).alias("with_errors"),
            total(F.col("risk_score").cast("bigint")).alias("scores"),
        )
        .select("user_id", F.col("w.start").alias("window_start"), "runs", "with_errors", "scores")
    )


def digest_of(parts: DataFrame) -> DataFrame:
    """Runs, runs with errors and mean score per user and window."""
    sums = parts.groupBy("user_id", "window_start").agg(*(F.sum(c).alias(c) for c in ("runs", "with_errors", "scores")))
    return sums.select(
        "user_id", "window_start", "runs", "with_errors", rounded_mean(F.col("scores"), F.col("runs")).alias("avg_score")
    )


def stream_alerts(reports: DataFrame, configs: DataFrame, owner: str) -> DataFrame:
    """Deliveries to make for each new report (append mode): stream-static join, no state."""
    return route_alerts(reports, configs, owner)


def stream_risk(batch: DataFrame) -> DataFrame:
    """Findings per query and severity of one micro-batch."""
    return batch.groupBy("query_id").agg(*severity_counts())


def risk_of(parts: DataFrame) -> DataFrame:
    """Score per query; it can only fall as findings arrive, and ends at the batch value."""
    counts = [c for c in parts.columns if c != "query_id"]
    sums = parts.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in counts))
    return sums.select("query_id", "errors", "warnings", "suggestions", score().alias("risk_score"))
