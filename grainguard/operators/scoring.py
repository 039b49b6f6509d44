"""Findings to scores, labels and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainguard.functions.severity import (
    HIGH_RISK_IMPACT,
    IMPACT,
    is_high_risk,
    is_severity,
    score,
    severity_counts,
)

_COUNTS = ["errors", "warnings", "suggestions", "high_risk"]


def risk_score(queries: DataFrame, findings: DataFrame) -> DataFrame:
    """Score per query; a query without findings keeps its 100. ``queries`` has one row per query_id."""
    counts = findings.groupBy("query_id").agg(*severity_counts())
    return (
        queries.select("query_id")
        .join(counts, "query_id", "left")
        .fillna(0, _COUNTS)
        .select("query_id", "errors", "warnings", "suggestions", score().alias("risk_score"))
    )


def normalize_findings(findings: DataFrame) -> DataFrame:
    """Fill offending table, column and score impact from the metadata map; values already set win."""

    def first_of(own: str, *keys: str):
        return F.coalesce(F.col(own), *[F.try_element_at("metadata", F.lit(k)) for k in keys])

    impact = F.when(is_high_risk(), F.lit(HIGH_RISK_IMPACT))
    for name, value in IMPACT.items():
        impact = impact.when(is_severity(name), F.lit(value))
    return findings.withColumns(
        {
            "offending_table": first_of("offending_table", "table", "tableName", "joinTable", "sourceTable"),
            "offending_column": first_of("offending_column", "column", "sourceColumn"),
            "score_impact": F.coalesce("score_impact", impact),
        }
    )


# The two label scales; (upper bound, label) pairs, first match wins.
VERDICTS = {
    "command_line": ((50, "RISKY"), (85, "REVIEW"), (None, "SAFE")),
    "panel": ((41, "Risky"), (85, "Review"), (None, "Safe")),
}


def verdict(df: DataFrame, kind: str = "command_line", column: str = "risk_score") -> DataFrame:
    """Label a score on one of the two scales."""
    *cuts, (_, last) = VERDICTS[kind]
    label = F.lit(last)
    for bound, name in reversed(cuts):
        label = F.when(F.col(column) < bound, name).otherwise(label)
    return df.withColumn("verdict", label)


def exit_gate(files: DataFrame, findings: DataFrame, run: Sequence[str], file: str, strict: bool = False) -> DataFrame:
    """Per run: does it fail, and how many of its files do. Strict runs fail on warnings too; clean runs are listed."""
    fails = F.col("severity").isin("error", "warning") if strict else is_severity("error")
    failing = findings.where(fails).select(file).distinct().withColumn("fails", F.lit(True))
    per_file = files.select(*run, file).distinct().join(failing, file, "left")
    return (
        per_file.groupBy(*run)
        .agg(F.count(F.lit(1)).alias("files"), F.count_if("fails").alias("failing_files"))
        .withColumn("exit_code", (F.col("failing_files") > 0).cast("int"))
    )


def dedupe_findings(findings: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seq",)) -> DataFrame:
    """The first finding per key in ``order``, chosen by value and not by arrival."""
    rest = [c for c in findings.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return findings.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*").select(*findings.columns)
