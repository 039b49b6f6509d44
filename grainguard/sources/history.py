"""The validation history as files: bounded scans, rows from findings, nested reports, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainguard.functions.severity import is_severity, score, severity_counts
from grainguard.operators.scoring import verdict
from grainguard.operators.times import naive

# Columns the analytics pages read; the scan never touches the others.
HISTORY_COLUMNS = ("id", "user_id", "risk_score", "error_count", "warning_count", "created_at")
PARTITION = "created_date"


def history_window(df: DataFrame, since: str, until: str | None = None, columns: Sequence[str] = HISTORY_COLUMNS) -> DataFrame:
    """Time-bounded, column-pruned history of all owners, keyed by owner.

    On a history partitioned by day the same bound also prunes folders.
    """
    bound = F.col("created_at") >= naive(since)
    if until is not None:
        bound = bound & (F.col("created_at") < naive(until))
    if PARTITION in df.columns:
        bound = bound & (F.col(PARTITION) >= naive(since).cast("date"))
        if until is not None:
            bound = bound & (F.col(PARTITION) <= naive(until).cast("date"))
    return df.where(bound).select(*columns)


def scan_history(spark: SparkSession, path: str, since: str, until: str | None = None) -> DataFrame:
    return history_window(spark.read.parquet(path), since, until)


def write_history(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write history rows by day.

    Rows are spread by day and an id hash first, so a day gets a bounded number
    of files and a busy day is still written by several tasks.
    """
    day = df.withColumn(PARTITION, F.col("created_at").cast("date"))
    spread = day.repartition(PARTITION, F.pmod(F.xxhash64("id"), F.lit(8)))
    spread.write.mode(mode).partitionBy(PARTITION).parquet(path)


def validation_rows(queries: DataFrame, findings: DataFrame) -> DataFrame:
    """History rows of a statement log: hash of the text, counts, score, dialect."""
    counts = findings.groupBy("query_id").agg(*severity_counts())
    return (
        queries.join(counts, "query_id", "left")
        .fillna(0, ["errors", "warnings", "suggestions", "high_risk"])
        .select(
            "query_id",
            F.sha2(F.col("sql_text").cast("binary"), 256).alias("sql_hash"),
            F.col("errors").alias("error_count"),
            F.col("warnings").alias("warning_count"),
            score().alias("risk_score"),
            F.coalesce("dialect", F.lit("postgresql")).alias("dialect"),
        )
    )


def file_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One line per checked file, clean ones too: counts, score, verdict, number of issues."""
    counted = findings.groupBy("query_id").agg(*severity_counts(), F.count(F.lit(1)).alias("issues"))
    counts = [c for c in counted.columns if c != "query_id"]
    per_file = files.select("query_id").distinct().join(counted, "query_id", "left").fillna(0, counts)
    return verdict(
        per_file.select("query_id", "errors", "warnings", "suggestions", "issues", score().alias("risk_score")), "command_line"
    )


def report_nest(findings: DataFrame, page_size: int = 1000) -> DataFrame:
    """Findings as nested reports: one array per severity, in finding order.

    Equal findings are folded to one entry with a count before they are
    collected, and a report with more than ``page_size`` entries is spread over
    several rows ("pages"), so a query that owns a third of all findings never
    becomes one array. ``execution_safe`` speaks for the whole report.
    """
    entries = findings.groupBy("query_id", "severity", "seq", "issue_id").agg(F.count(F.lit(1)).alias("n"))
    heads = entries.groupBy("query_id").agg(
        F.bool_and(~is_severity("error")).alias("execution_safe"),
        F.ceil(F.count(F.lit(1)) / F.lit(page_size)).alias("pages"),
    )
    paged = entries.join(heads, "query_id").withColumn(
        "page", F.pmod(F.xxhash64("severity", "seq", "issue_id"), F.col("pages")).cast("int")
    )
    item = F.struct("seq", "issue_id", "n")

    def part(name):
        return F.sort_array(F.collect_list(F.when(is_severity(name), item))).alias(f"{name}s")

    return paged.groupBy("query_id", "page", "pages", "execution_safe").agg(
        part("error"), part("warning"), part("suggestion")
    )


def report_explode(reports: DataFrame) -> DataFrame:
    """Nested reports back to one row per finding."""

    def labelled(name):
        return F.transform(
            f"{name}s", lambda x: F.struct(F.lit(name).alias("severity"), x.seq.alias("seq"), x.issue_id.alias("issue_id"), x.n.alias("n"))
        )

    entry = F.explode(F.concat(labelled("error"), labelled("warning"), labelled("suggestion")))
    rows = reports.select("query_id", entry.alias("f")).select("query_id", "f.*")
    # Repeats come back in blocks, so a finding repeated a billion times needs no array of that length.
    block = 1000
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {block}"))))
    size = F.least(F.lit(block), F.col("n") - F.col("_block") * block).cast("int")
    return blocks.withColumn("_one", F.explode(F.array_repeat(F.lit(1), size))).select(
        "query_id", "severity", "seq", "issue_id"
    )


AUDIT_COLUMNS = ("timestamp", "user_email", "event_type", "risk_score", "issue_types", "sql_hash")


def audit_rows(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Audit lines: run columns beside the distinct issue types joined by '|'; NULL becomes empty text.

    Distinct types per run are bounded by the closed set of issue ids.
    """
    types = findings.select("query_id", "issue_id").distinct().groupBy("query_id").agg(
        F.array_join(F.sort_array(F.collect_list("issue_id")), "|").alias("issue_types")
    )
    joined = runs.join(types, "query_id", "left")
    return joined.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in AUDIT_COLUMNS])


def audit_csv(rows: DataFrame, path: str) -> None:
    """Write audit lines as CSV; cells with a comma, quote or line break are quoted, quotes doubled."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in AUDIT_COLUMNS)
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
    return reader.csv(path).fillna("")
