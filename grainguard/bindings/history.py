"""Scoring and history analytics on findings and validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainguard.bindings.registry import bind
from grainguard.functions.severity import DESTRUCTIVE, HIGH_RISK_WARNINGS
from grainguard.operators import history as H
from grainguard.operators import scoring as S
from grainguard.sources.tables import AS_OF


def _names(values):
    return ", ".join(f"'{v}'" for v in values)


COUNTS_SQL = f"""
    c AS (SELECT query_id, COUNT(*) FILTER (WHERE severity = 'error') AS errors,
                 COUNT(*) FILTER (WHERE severity = 'warning') AS warnings,
                 COUNT(*) FILTER (WHERE severity = 'suggestion') AS suggestions,
                 COUNT(*) FILTER (WHERE severity = 'warning' AND issue_id IN ({_names(HIGH_RISK_WARNINGS)})) AS high_risk
          FROM findings GROUP BY 1),
    q AS (SELECT query_log.query_id, dialect, sql_text, COALESCE(errors, 0) AS errors, COALESCE(warnings, 0) AS warnings,
                 COALESCE(suggestions, 0) AS suggestions, COALESCE(high_risk, 0) AS high_risk
          FROM query_log LEFT JOIN c ON c.query_id = query_log.query_id)"""
SCORE_SQL = """CAST(CASE WHEN errors > 0 THEN GREATEST(0, 40 - 15 * errors)
                         WHEN warnings > 0 AND high_risk > 0 THEN GREATEST(41, 60 - 6 * (high_risk - 1))
                         WHEN warnings > 0 THEN GREATEST(70, 80 - 4 * (warnings - 1))
                         WHEN suggestions > 0 THEN GREATEST(85, 100 - 5 * suggestions) ELSE 100 END AS INT)"""


@bind(
    "risk_score",
    f"WITH {COUNTS_SQL} SELECT query_id, errors, warnings, suggestions, {SCORE_SQL} AS risk_score FROM q",
)
def _(t):
    return S.risk_score(t.query_log, t.findings)


@bind(
    "normalize_findings",
    f"""
    WITH m AS (SELECT l_orderkey AS query_id, l_linenumber AS seq, l_partkey % 10 AS p, 't' || (l_partkey % 7) AS name,
                      CAST(l_suppkey % 5 AS INT) AS place, l_quantity AS q FROM lineitem),
         f AS (SELECT *, CASE WHEN p IN (0, 1, 9) THEN 'error' WHEN p IN (2, 3, 4, 5) THEN 'warning'
                              ELSE 'suggestion' END AS severity, p IN (2, 3) AS high FROM m)
    SELECT query_id, seq, severity,
           CASE WHEN q > 45 THEN 'explicit' WHEN place < 4 THEN name END AS offending_table,
           CASE WHEN place = 0 THEN 'c1' WHEN place = 3 THEN 'c2' END AS offending_column,
           CAST(CASE WHEN q < 5 THEN -1 WHEN high THEN -40 WHEN severity = 'error' THEN -75
                     WHEN severity = 'warning' THEN -25 ELSE -5 END AS INT) AS score_impact
    FROM f""",
)
def _(t):
    # The raw shape of a finding: sparse columns beside a metadata map whose key names differ by detector.
    place = F.pmod("l_suppkey", F.lit(5))
    name = F.concat(F.lit("t"), F.pmod("l_partkey", F.lit(7)).cast("string"))
    metadata = (
        F.when(place == 0, F.create_map(F.lit("table"), name, F.lit("column"), F.lit("c1")))
        .when(place == 1, F.create_map(F.lit("tableName"), name))
        .when(place == 2, F.create_map(F.lit("joinTable"), name))
        .when(place == 3, F.create_map(F.lit("sourceTable"), name, F.lit("sourceColumn"), F.lit("c2")))
    )
    p = F.pmod("l_partkey", F.lit(10))
    raw = t.lineitem.select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_linenumber").alias("seq"),
        F.when(p == 2, "LEFT_JOIN_FILTERED_IN_WHERE").when(p == 3, "MISSING_TIME_FILTER").otherwise("OTHER").alias("issue_id"),
        F.when(p.isin(0, 1, 9), "error").when(p.isin(2, 3, 4, 5), "warning").otherwise("suggestion").alias("severity"),
        F.when(F.col("l_quantity") > 45, "explicit").alias("offending_table"),
        F.lit(None).cast("string").alias("offending_column"),
        F.when(F.col("l_quantity") < 5, -1).alias("score_impact"),
        metadata.alias("metadata"),
    )
    return S.normalize_findings(raw).drop("metadata", "issue_id")


for _kind, _cuts in (("command_line", "50 RISKY REVIEW SAFE"), ("panel", "41 Risky Review Safe")):
    _low, _a, _b, _c = _cuts.split()

    @bind(
        "verdict" if _kind == "command_line" else "verdict_panel",
        f"""
    SELECT id, risk_score, CASE WHEN risk_score < {_low} THEN '{_a}' WHEN risk_score < 85 THEN '{_b}'
                                ELSE '{_c}' END AS verdict FROM validations""",
    )
    def _(t, kind=_kind):
        return S.verdict(t.validations.select("id", "risk_score"), kind)


for _strict in (False, True):

    @bind(
        "exit_gate_strict" if _strict else "exit_gate",
        f"""
    WITH f AS (SELECT query_id // 100 AS run_id, query_id, query_id IN (SELECT query_id FROM findings
                      WHERE severity IN ({"'error', 'warning'" if _strict else "'error'"})) AS fails
               FROM query_log)
    SELECT run_id, COUNT(*) AS files, COUNT(*) FILTER (WHERE fails) AS failing_files,
           CAST(BOOL_OR(fails) AS INT) AS exit_code FROM f GROUP BY 1""",
    )
    def _(t, strict=_strict):
        files = t.query_log.withColumn("run_id", F.expr("query_id div 100"))
        return S.exit_gate(files, t.findings, ["run_id"], "query_id", strict)


@bind(
    "dedupe_findings",
    "SELECT query_id, MIN(seq) AS seq, issue_id, MIN(severity) AS severity FROM findings GROUP BY query_id, issue_id",
)
def _(t):
    return S.dedupe_findings(t.findings, ["query_id", "issue_id"])


# ---------------------------------------------------------------- history


@bind(
    "overview",
    """
    SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE error_count > 0) AS errors_caught,
           COUNT(*) FILTER (WHERE warning_count > 0) AS warnings_caught,
           COUNT(*) FILTER (WHERE error_count = 0 AND warning_count = 0) AS clean_queries FROM validations""",
)
def _(t):
    return H.overview(t.validations)


@bind(
    "source_stats",
    """
    WITH s AS (SELECT COALESCE(source, 'unknown') AS source, COUNT(*) AS n,
                      COUNT(*) FILTER (WHERE error_count > 0) AS e,
                      COUNT(*) FILTER (WHERE error_count = 0 AND warning_count > 0) AS w FROM validations GROUP BY 1)
    SELECT source, CASE source WHEN 'manual' THEN 'Hand-written' WHEN 'cursor' THEN 'Cursor' WHEN 'copilot' THEN 'Copilot'
                               WHEN 'chatgpt' THEN 'ChatGPT' WHEN 'unknown' THEN 'Unknown' ELSE source END AS label,
           n AS validations, e AS errors, w AS warnings, CAST(FLOOR((n - e - w) / n * 100 + 0.5) AS BIGINT) AS pass_rate,
           CASE source WHEN 'manual' THEN 0 WHEN 'cursor' THEN 1 WHEN 'copilot' THEN 2 WHEN 'chatgpt' THEN 3
                       WHEN 'unknown' THEN 4 ELSE 99 END AS place FROM s""",
)
def _(t):
    return H.source_stats(t.validations)


@bind(
    "top_issue_types",
    """
    SELECT issue_id AS issue_type, COUNT(*) AS count,
           CAST(FLOOR(COUNT(*) / (SELECT COUNT(*) FROM validations) * 100 + 0.5) AS BIGINT) AS pct
    FROM findings WHERE severity IN ('error', 'warning') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def _(t):
    return H.top_issue_types(t.findings, t.validations, 5)


@bind(
    "score_distribution",
    """
    SELECT COUNT(*) FILTER (WHERE risk_score <= 40) AS risky,
           COUNT(*) FILTER (WHERE risk_score BETWEEN 41 AND 69) AS review,
           COUNT(*) FILTER (WHERE risk_score BETWEEN 70 AND 84) AS caution,
           COUNT(*) FILTER (WHERE risk_score >= 85) AS safe FROM validations""",
)
def _(t):
    return H.score_distribution(t.validations)


@bind(
    "overview_by_team",
    """
    SELECT team_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE error_count > 0) AS errors_caught,
           COUNT(*) FILTER (WHERE warning_count > 0) AS warnings_caught,
           COUNT(*) FILTER (WHERE error_count = 0 AND warning_count = 0) AS clean_queries FROM validations GROUP BY 1""",
)
def _(t):
    return H.overview(t.validations, ["team_id"])


@bind(
    "source_stats_by_team",
    """
    WITH s AS (SELECT team_id, COALESCE(source, 'unknown') AS source, COUNT(*) AS n,
                      COUNT(*) FILTER (WHERE error_count > 0) AS e,
                      COUNT(*) FILTER (WHERE error_count = 0 AND warning_count > 0) AS w FROM validations GROUP BY 1, 2)
    SELECT team_id, source,
           CASE source WHEN 'manual' THEN 'Hand-written' WHEN 'cursor' THEN 'Cursor' WHEN 'copilot' THEN 'Copilot'
                       WHEN 'chatgpt' THEN 'ChatGPT' WHEN 'unknown' THEN 'Unknown' ELSE source END AS label,
           n AS validations, e AS errors, w AS warnings, CAST(FLOOR((n - e - w) / n * 100 + 0.5) AS BIGINT) AS pass_rate,
           CASE source WHEN 'manual' THEN 0 WHEN 'cursor' THEN 1 WHEN 'copilot' THEN 2 WHEN 'chatgpt' THEN 3
                       WHEN 'unknown' THEN 4 ELSE 99 END AS place FROM s""",
)
def _(t):
    return H.source_stats(t.validations, by=["team_id"])


@bind(
    "top_issue_types_by_team",
    """
    WITH r AS (SELECT team_id, COUNT(*) AS runs FROM validations GROUP BY 1),
         c AS (SELECT team_id, issue_id, COUNT(*) AS n FROM findings JOIN validations ON id = query_id
               WHERE severity IN ('error', 'warning') GROUP BY 1, 2
               QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY COUNT(*) DESC, issue_id) <= 10)
    SELECT c.team_id, issue_id AS issue_type, n AS count, CAST(FLOOR(n / runs * 100 + 0.5) AS BIGINT) AS pct
    FROM c JOIN r ON r.team_id = c.team_id""",
)
def _(t):
    return H.top_issue_types(t.findings, t.validations, 10, ["team_id"])


@bind(
    "score_distribution_by_team",
    """
    SELECT team_id, COUNT(*) FILTER (WHERE risk_score <= 40) AS risky,
           COUNT(*) FILTER (WHERE risk_score BETWEEN 41 AND 69) AS review,
           COUNT(*) FILTER (WHERE risk_score BETWEEN 70 AND 84) AS caution,
           COUNT(*) FILTER (WHERE risk_score >= 85) AS safe FROM validations GROUP BY 1""",
)
def _(t):
    return H.score_distribution(t.validations, ["team_id"])


@bind(
    "risky_log_by_team",
    """
    WITH r AS (SELECT * FROM validations WHERE risk_score < 70
               QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, id) <= 20)
    SELECT team_id, id, user_id, risk_score, created_at,
           COALESCE((SELECT issue_id FROM findings WHERE query_id = id AND severity IN ('error', 'warning')
                     ORDER BY severity, seq, issue_id LIMIT 1), '—') AS top_issue FROM r""",
)
def _(t):
    return H.risky_log(t.validations, t.findings, 20, by=["team_id"])


_BOARD = """
    SELECT {cols}, COUNT(*) AS validations,
           CAST(FLOOR(COUNT(*) FILTER (WHERE error_count = 0 AND warning_count = 0) / COUNT(*) * 100 + 0.5) AS BIGINT) AS pass_rate,
           CAST(FLOOR(SUM(risk_score) / COUNT(*) + 0.5) AS BIGINT) AS avg_score
    FROM validations GROUP BY {cols_by}"""


@bind("member_leaderboard", _BOARD.format(cols="user_id AS member", cols_by="user_id"))
def _(t):
    return H.member_leaderboard(t.validations, "user_id")


_PEOPLE_SQL = """
    members AS (SELECT CAST(c_custkey % 20 AS INT) AS team_id, c_custkey AS user_id,
                       CASE WHEN c_nationkey < 10 THEN lower(c_name) || '@team.example' END AS email
                FROM customer),
    users AS (SELECT c_custkey AS user_id, CASE WHEN c_nationkey < 20 THEN lower(c_name) || '@user.example' END AS email
              FROM customer)"""


def _people(t):
    c = t.customer
    members = c.select(
        F.expr("cast(c_custkey % 20 as int)").alias("team_id"),
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_nationkey") < 10, F.concat(F.lower("c_name"), F.lit("@team.example"))).alias("email"),
    )
    users = c.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_nationkey") < 20, F.concat(F.lower("c_name"), F.lit("@user.example"))).alias("email"),
    )
    return users, members


@bind(
    "member_attribution",
    f"""
    WITH {_PEOPLE_SQL}
    SELECT v.id, m.team_id, COALESCE(m.email, u.email, 'unknown') AS member, v.risk_score
    FROM validations v JOIN members m ON m.user_id = v.user_id LEFT JOIN users u ON u.user_id = v.user_id
    WHERE v.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS""",
)
def _(t):
    users, members = _people(t)
    return H.member_attribution(t.validations, users, members, AS_OF).select("id", "team_id", "member", "risk_score")


@bind(
    "team_overview",
    """
    WITH b AS (SELECT team_id, user_id, FLOOR(COUNT(*) FILTER (WHERE error_count = 0 AND warning_count = 0) / COUNT(*) * 100 + 0.5) AS p,
                      FLOOR(SUM(risk_score) / COUNT(*) + 0.5) AS a FROM validations GROUP BY 1, 2),
         w AS (SELECT team_id, user_id FROM b QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY p, a, user_id DESC) = 1),
         i AS (SELECT team_id, issue_id, COUNT(*) AS n FROM findings JOIN validations ON id = query_id
               WHERE severity IN ('error', 'warning') GROUP BY 1, 2
               QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY COUNT(*) DESC, issue_id) = 1),
         s AS (SELECT team_id, COUNT(*) AS total, CAST(FLOOR(SUM(risk_score) / COUNT(*) + 0.5) AS BIGINT) AS avg_score
               FROM validations GROUP BY 1)
    SELECT s.team_id, total, avg_score, i.issue_id AS most_common_issue, w.user_id AS lowest_member
    FROM s LEFT JOIN i ON i.team_id = s.team_id LEFT JOIN w ON w.team_id = s.team_id""",
)
def _(t):
    return H.team_overview(t.validations, t.findings, "team_id", "user_id")


@bind(
    "risky_log",
    """
    WITH r AS (SELECT * FROM validations WHERE risk_score < 70 ORDER BY created_at DESC, id LIMIT 20)
    SELECT id, user_id, risk_score, created_at,
           COALESCE((SELECT issue_id FROM findings WHERE query_id = id AND severity IN ('error', 'warning')
                     ORDER BY severity, seq, issue_id LIMIT 1), '—') AS top_issue FROM r""",
)
def _(t):
    return H.risky_log(t.validations, t.findings, 20)


PERIOD_SQL = f"""
    v AS (SELECT *, created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AS now FROM validations
          WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS AND created_at <= TIMESTAMP '{AS_OF}'),
    s AS (SELECT user_id, COUNT(*) FILTER (WHERE now) AS total, COUNT(*) FILTER (WHERE now AND error_count > 0) AS with_errors,
                 CAST(COALESCE(FLOOR(AVG(risk_score) FILTER (WHERE now) + 0.5), 0) AS BIGINT) AS avg_score,
                 CAST(COALESCE(FLOOR(AVG(risk_score) FILTER (WHERE NOT now) + 0.5), 0) AS BIGINT) AS prev_avg_score
          FROM v GROUP BY 1),
    n AS (SELECT user_id, issue_id, COUNT(*) AS n FROM findings JOIN v ON id = query_id
          WHERE now AND severity IN ('error', 'warning') GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, issue_id) <= 3),
    g AS (SELECT user_id, string_agg(issue_id || ':' || n, '|' ORDER BY n DESC, issue_id) AS top_issues FROM n GROUP BY 1),
    d AS (SELECT s.*, avg_score - prev_avg_score AS score_trend, COALESCE(top_issues, '') AS top_issues
          FROM s LEFT JOIN g ON g.user_id = s.user_id)"""


def digest_text(df):
    """Arrays of structs as text, so any client can compare them."""
    pairs = F.transform("top_issues", lambda x: F.concat_ws(":", x["issue_type"], x["count"].cast("string")))
    return df.withColumn("top_issues", F.array_join(pairs, "|"))


@bind("period_digest", f"WITH {PERIOD_SQL} SELECT * FROM d")
def _(t):
    return digest_text(H.period_digest(t.validations, t.findings, AS_OF))


def _certified(runs, score):
    return f"""
    WITH r AS (SELECT *, EXISTS (SELECT 1 FROM findings WHERE query_id = id AND severity = 'error'
                                   AND issue_id IN ({_names(DESTRUCTIVE)})) AS bad FROM validations
               WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS AND created_at <= TIMESTAMP '{AS_OF}'),
         s AS (SELECT user_id, COUNT(*) AS validations, CAST(FLOOR(AVG(risk_score) + 0.5) AS BIGINT) AS avg_score,
                      COUNT(*) FILTER (WHERE bad) AS destructive_runs FROM r GROUP BY 1)
    SELECT *, validations >= {runs} AND avg_score >= {score} AND destructive_runs = 0 AS certified FROM s"""


@bind("certification", _certified(100, 85))
def _(t):
    return H.certification(t.validations, t.findings, AS_OF)


@bind("certification_low_bar", _certified(1, 60))
def _(t):
    return H.certification(t.validations, t.findings, AS_OF, runs=1, score=60)


@bind(
    "audit_rollup",
    """
    SELECT CAST(user_id % 20 AS INT) AS team, strftime(ts, '%Y-%m-%d') AS day, kind, COUNT(*) AS events,
           COUNT(DISTINCT user_id) AS users, MAX(ts) AS last_event FROM deliveries GROUP BY 1, 2, 3""",
)
def _(t):
    log = t.deliveries.withColumn("team_id", F.expr("cast(user_id % 20 as int)"))
    df = H.audit_rollup(log, "team_id", "ts", "kind", "user_id")
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
