"""Streaming jobs run to the end of the given files; their results equal the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainguard.bindings.governance import ROUTED_SQL, _claims, hooks
from grainguard.bindings.history import COUNTS_SQL, SCORE_SQL
from grainguard.bindings.registry import bind
from grainguard.session import new_folder
from grainguard.sources.tables import SCHEMAS, VIEWS
from grainguard.streaming import files, jobs, levels
from grainguard.streaming.claims import outcomes_of, stream_claims


def _stream(t, view, table):
    """The derived view over a stream of one table's files."""
    source = files.read_files(t.spark, SCHEMAS[table], t.folder, f"{table}.parquet")
    return t.spark.sql(VIEWS[view].replace(f"FROM {table}", "FROM {source}"), source=source)


def _parts(t, view, table, purpose, reduce, fold):
    """The partial results of all micro-batches, merged by level."""
    out = levels.run_folded(_stream(t, view, table), new_folder(t.spark, purpose), lambda batch, _: reduce(batch), fold)
    return levels.read_parts(t.spark, out)


def _added(*keys):
    return lambda parts: jobs.added_up(parts, keys)


@bind(
    "stream_usage",
    "SELECT user_id, strftime(created_at, '%Y-%m') AS month, COUNT(*) AS runs FROM validations GROUP BY 1, 2",
)
def _(t):
    months = jobs.usage_by_month(_parts(t, "validations", "orders", "usage", jobs.stream_usage, _added("user_id", "day")))
    return months.withColumn("month", F.date_format("month", "yyyy-MM"))


@bind("stream_dedup", "SELECT DISTINCT delivery_key FROM deliveries")
def _(t):
    return jobs.keys_of(_parts(t, "deliveries", "events", "dedup", lambda b: jobs.stream_dedup(b, "delivery_key"), jobs.keys_of))


@bind("stream_claims", _claims("5 MINUTES"))
def _(t):
    source = _stream(t, "deliveries", "events")
    path = stream_claims(source, new_folder(t.spark, "claims"), "delivery_key", "ts", "attempt", "completed")
    return outcomes_of(t.spark, path, "delivery_key", "attempt")


def _windows(width, slide):
    back = width // slide
    return f"""
    WITH k AS (SELECT UNNEST(range({back})) AS k),
         v AS (SELECT *, TIMESTAMP '1970-01-01 00:00:00' + to_days(CAST(CAST(epoch(created_at) AS BIGINT) // 86400 // {slide} * {slide} AS INT)) AS last_start
               FROM validations),
         w AS (SELECT v.*, last_start - to_days(CAST(k * {slide} AS INT)) AS window_start FROM v, k)
    SELECT user_id, strftime(window_start, '%Y-%m-%d') AS window_start, COUNT(*) AS runs,
           COUNT(*) FILTER (WHERE error_count > 0) AS with_errors,
           CAST(FLOOR(AVG(risk_score) + 0.5) AS BIGINT) AS avg_score
    FROM w WHERE created_at < window_start + to_days({width}) GROUP BY 1, 2"""


def _digest(t, window, slide=None):
    df = jobs.digest_of(_parts(
        t, "validations", "orders", "digest", lambda b: jobs.stream_digest(b, window, slide), _added("user_id", "window_start")
    ))
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@bind("stream_digest", _windows(7, 7))
def _(t):
    return _digest(t, "7 days")


@bind("stream_digest_sliding", _windows(30, 10))
def _(t):
    return _digest(t, "30 days", "10 days")


@bind("stream_alerts", ROUTED_SQL)
def _(t):
    alerts = jobs.stream_alerts(_stream(t, "validations", "orders"), hooks(t), "user_id")
    return files.all_batches(t.spark, files.run_available(alerts, new_folder(t.spark, "alerts"), "append"))


@bind(
    "stream_risk",
    f"""
    WITH {COUNTS_SQL}
    SELECT query_id, errors, warnings, suggestions, {SCORE_SQL} AS risk_score FROM q
    WHERE errors + warnings + suggestions > 0""",
)
def _(t):
    return jobs.risk_of(_parts(t, "findings", "lineitem", "risk", jobs.stream_risk, _added("query_id")))
