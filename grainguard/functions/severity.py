"""Fixed values of findings: severities, high-risk ids, score bands and default impacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning", "suggestion")

# Warnings that land a query in the 41-69 band.
HIGH_RISK_WARNINGS = (
    "LEFT_JOIN_FILTERED_IN_WHERE",
    "SUSPICIOUS_JOIN_KEY",
    "CROSS_JOIN_RISK",
    "MULTIPLE_ONE_TO_MANY_JOINS",
    "SCD_JOIN_WITHOUT_EFFECTIVE_DATE",
    "MISSING_TIME_FILTER",
    "DIALECT_MISMATCH",
    "AMBIGUOUS_COLUMN",
    "COALESCE_IN_JOIN_KEY",
    "WINDOW_MISSING_ORDER",
)

# Findings that count as destructive.
DESTRUCTIVE = ("MISSING_WHERE_DESTRUCTIVE", "DESTRUCTIVE_DDL", "DESTRUCTIVE_TRUNCATE")

# Default score impact.
IMPACT = {"error": -75, "warning": -25, "suggestion": -5}
HIGH_RISK_IMPACT = -40


def is_severity(name: str) -> Column:
    return F.col("severity") == name


def is_high_risk() -> Column:
    return is_severity("warning") & F.col("issue_id").isin(*HIGH_RISK_WARNINGS)


def severity_counts() -> list[Column]:
    """Aggregates every scoring job needs, as map-side combined counts."""
    return [
        F.count_if(is_severity("error")).alias("errors"),
        F.count_if(is_severity("warning")).alias("warnings"),
        F.count_if(is_severity("suggestion")).alias("suggestions"),
        F.count_if(is_high_risk()).alias("high_risk"),
    ]


def score() -> Column:
    """Risk score from the counts: the worst severity sets the band, more findings lower it inside the band."""
    e, w, s, h = F.col("errors"), F.col("warnings"), F.col("suggestions"), F.col("high_risk")
    value = (
        F.when(e > 0, F.greatest(F.lit(0), 40 - 15 * e))
        .when((w > 0) & (h > 0), F.greatest(F.lit(41), 60 - 6 * (h - 1)))
        .when(w > 0, F.greatest(F.lit(70), 80 - 4 * (w - 1)))
        .when(s > 0, F.greatest(F.lit(85), 100 - 5 * s))
        .otherwise(F.lit(100))
    )
    return value.cast("int")
