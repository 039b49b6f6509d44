"""Catalog and history sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainguard.bindings.history import COUNTS_SQL, SCORE_SQL
from grainguard.bindings.registry import bind
from grainguard.session import new_folder
from grainguard.sources import catalog as C
from grainguard.sources import history as H

SINCE, UNTIL = "2001-05-01 00:00:00", "2001-07-15 12:00:00"


@bind(
    "scan_history",
    f"""
    SELECT id, user_id, risk_score, error_count, warning_count, created_at FROM validations
    WHERE created_at >= TIMESTAMP '{SINCE}' AND created_at < TIMESTAMP '{UNTIL}'""",
)
def _(t):
    return H.history_window(t.validations, SINCE, UNTIL)


_TYPE_SQL = "CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TYPE_NAMES.items()) + " ELSE lower(trim({c})) END"


@bind(
    "catalog_fold",
    f"""
    WITH r AS (SELECT * FROM catalog_log WHERE table_name <> '' AND column_name <> '')
    SELECT database_id, table_name, column_name, ARG_MIN({_TYPE_SQL.format(c="data_type")}, ord) AS type,
           ARG_MIN(is_nullable = 'YES', ord) AS nullable,
           COALESCE(BOOL_OR(constraint_type = 'PRIMARY KEY'), FALSE) AS is_pk,
           COALESCE(BOOL_OR(constraint_type = 'FOREIGN KEY'), FALSE) AS is_fk,
           ARG_MAX(foreign_table_name, ord) FILTER (WHERE constraint_type = 'FOREIGN KEY') AS fk_table,
           ARG_MAX(foreign_column_name, ord) FILTER (WHERE constraint_type = 'FOREIGN KEY') AS fk_column,
           MIN(ord) AS ord
    FROM r GROUP BY 1, 2, 3""",
)
def _(t):
    return C.catalog_fold(t.catalog_log, ["database_id"])


@bind(
    "catalog_flat",
    f"""
    WITH r AS (SELECT * FROM catalog_log WHERE table_name <> '' AND column_name <> '')
    SELECT database_id, {{n}} AS table_name, column_name, {_TYPE_SQL.format(c="data_type")} AS type,
           is_nullable = 'YES' AS nullable, FALSE AS is_pk, FALSE AS is_fk FROM r""".replace("{n}", "table_name")
    + f"""
    UNION ALL SELECT database_id, upper(table_name), upper(column_name), {_TYPE_SQL.format(c="data_type")},
           is_nullable = 'YES', FALSE, FALSE FROM r""",
)
def _(t):
    flat = t.catalog_log.select("database_id", *C.FLAT_COLUMNS)
    shouting = flat.select(
        F.col("database_id").alias("DATABASE_ID"),
        F.upper("table_name").alias("TABLE_NAME"),
        F.upper("column_name").alias("COLUMN_NAME"),
        F.col("data_type").alias("DATA_TYPE"),
        F.col("is_nullable").alias("IS_NULLABLE"),
    )
    return C.catalog_flat(flat, shouting, keep=["database_id"])


@bind(
    "catalog_ingest",
    """
    SELECT database_id, table_name, column_name, data_type, is_nullable, constraint_type, foreign_table_name, foreign_column_name
    FROM catalog_log WHERE table_name <> ''""",
)
def _(t):
    """The catalog query on information-schema tables of all databases; the JDBC reader feeds the same shape."""
    log = t.catalog_log.repartition("database_id")  # distinct rows are found where they meet, not in the few tasks that read customers
    schema = F.when(F.col("table_name") == "", "private").otherwise("public").alias("table_schema")
    tables = log.select("database_id", schema, "table_name", F.lit("BASE TABLE").alias("table_type")).distinct()
    views = tables.withColumns({"table_name": F.concat("table_name", F.lit("_view")), "table_type": F.lit("VIEW")})
    columns = log.select("database_id", schema, "table_name", "column_name", "data_type", "is_nullable").distinct()
    name = F.concat_ws("_", "table_name", "column_name", "ord").alias("constraint_name")
    keys = log.where("constraint_type IS NOT NULL")
    return C.catalog_rows_from_tables(
        tables.unionByName(views),
        columns,
        keys.select("database_id", name, "table_name", "column_name"),
        keys.select("database_id", name, "constraint_type"),
        keys.where("foreign_table_name IS NOT NULL").select(
            "database_id", name, F.col("foreign_table_name").alias("table_name"), F.col("foreign_column_name").alias("column_name")
        ),
        "public",
        ["database_id"],
    )


@bind(
    "validation_rows",
    f"""
    WITH {COUNTS_SQL}
    SELECT query_id, sha256(sql_text) AS sql_hash, errors AS error_count, warnings AS warning_count,
           {SCORE_SQL} AS risk_score, dialect FROM q""",
)
def _(t):
    return H.validation_rows(t.query_log, t.findings)


@bind(
    "file_summary",
    f"""
    WITH {COUNTS_SQL}, s AS (SELECT *, {SCORE_SQL} AS risk_score FROM q)
    SELECT query_id, errors, warnings, suggestions, errors + warnings + suggestions AS issues, risk_score,
           CASE WHEN risk_score < 50 THEN 'RISKY' WHEN risk_score < 85 THEN 'REVIEW' ELSE 'SAFE' END AS verdict
    FROM s""",
)
def _(t):
    return H.file_summary(t.query_log, t.findings)


def _joined_sql(severity):
    return f"""COALESCE(string_agg(seq || ':' || issue_id || ':' || n, '|' ORDER BY seq, issue_id)
                 FILTER (WHERE severity = '{severity}'), '')"""


@bind(
    "report_nest",
    f"""
    WITH e AS (SELECT query_id, severity, seq, issue_id, COUNT(*) AS n FROM findings GROUP BY ALL)
    SELECT query_id, 0 AS page, BOOL_AND(severity <> 'error') AS execution_safe, {_joined_sql("error")} AS errors,
           {_joined_sql("warning")} AS warnings, {_joined_sql("suggestion")} AS suggestions
    FROM e GROUP BY query_id""",
)
def _(t):
    nested = H.report_nest(t.findings)

    def text(c):
        return F.array_join(
            F.transform(c, lambda x: F.concat_ws(":", x.seq.cast("string"), x.issue_id, x.n.cast("string"))), "|"
        ).alias(c)

    return nested.select("query_id", "page", "execution_safe", text("errors"), text("warnings"), text("suggestions"))


@bind("report_explode", "SELECT query_id, severity, seq, issue_id FROM findings")
def _(t):
    return H.report_explode(H.report_nest(t.findings))


@bind(
    "audit_csv",
    f"""
    WITH {COUNTS_SQL},
         i AS (SELECT query_id, string_agg(DISTINCT issue_id, '|' ORDER BY issue_id) AS issue_types FROM findings GROUP BY 1)
    SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp, 'user ' || o_custkey || ', "' || o_orderstatus || '"' AS user_email,
           'validation_run' AS event_type, CAST({SCORE_SQL} AS VARCHAR) AS risk_score,
           COALESCE(issue_types, '') AS issue_types, sha256(sql_text) AS sql_hash
    FROM orders JOIN q ON q.query_id = o_orderkey LEFT JOIN i ON i.query_id = o_orderkey""",
)
def _(t):
    """Written as CSV and read back, so the quoting is part of the check."""
    runs = t.orders.select(
        F.col("o_orderkey").alias("query_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("user "), F.col("o_custkey").cast("string"), F.lit(', "'), "o_orderstatus", F.lit('"')).alias("user_email"),
        F.lit("validation_run").alias("event_type"),
    ).join(H.validation_rows(t.query_log, t.findings).select("query_id", "risk_score", "sql_hash"), "query_id")
    path = new_folder(t.spark, "audit")
    H.audit_csv(H.audit_rows(runs, t.findings), path)
    return H.read_audit_csv(t.spark, path)
