"""Analytics over the validation history and its findings, for all users and teams in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainguard.functions.numbers import percent, rounded_mean
from grainguard.functions.severity import DESTRUCTIVE
from grainguard.operators.times import days_before, naive
from grainguard.plans.shapes import total



def _has_error() -> Column:
    return F.col("error_count") > 0


def _clean() -> Column:
    return (F.col("error_count") == 0) & (F.col("warning_count") == 0)


def _reported(findings: DataFrame) -> DataFrame:
    """Findings the reports count: errors and warnings."""
    return findings.where(F.col("severity").isin("error", "warning"))


def overview(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs, and runs with errors, with warnings and clean; for everyone, or per owner or team in ``by``."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_has_error()).alias("errors_caught"),
        F.count_if(F.col("warning_count") > 0).alias("warnings_caught"),
        F.count_if(_clean()).alias("clean_queries"),
    )


# Display order and labels of the known sources.
SOURCE_LABELS = {
    "manual": "Hand-written",
    "cursor": "Cursor",
    "copilot": "Copilot",
    "chatgpt": "ChatGPT",
    "unknown": "Unknown",
}


def source_stats(df: DataFrame, report_source: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Runs per source: known sources first in display order, others by volume."""
    fallback = [F.col(report_source)] if report_source else []
    place = F.lit(99)
    label = F.col("source")
    for i, (name, text) in reversed(list(enumerate(SOURCE_LABELS.items()))):
        place = F.when(F.col("source") == name, i).otherwise(place)
        label = F.when(F.col("source") == name, text).otherwise(label)
    return (
        df.groupBy(*by, F.coalesce(F.col("source"), *fallback, F.lit("unknown")).alias("source"))
        .agg(
            F.count(F.lit(1)).alias("validations"),
            F.count_if(_has_error()).alias("errors"),
            F.count_if(~_has_error() & (F.col("warning_count") > 0)).alias("warnings"),
        )
        .select(
            *by,
            "source",
            label.alias("label"),
            "validations",
            "errors",
            "warnings",
            percent(F.col("validations") - F.col("errors") - F.col("warnings"), F.col("validations")).alias("pass_rate"),
            place.alias("place"),
        )
        .orderBy(*by, "place", F.desc("validations"), "source")
    )


def top_issue_types(findings: DataFrame, runs: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent issues among errors and warnings, as counts and percent of runs.

    With ``by``, columns of ``runs``, the first n of each owner or team; findings meet their run by id.
    """
    if by:
        owned = _reported(findings).join(runs.select(F.col("id").alias("query_id"), *by), "query_id")
        counts = owned.groupBy(*by, F.col("issue_id").alias("issue_type")).agg(F.count(F.lit(1)).alias("count"))
        # One row per owner and issue id: the window is small.
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "issue_type"))
        wholes = runs.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_runs"))
        mine = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
        top = counts.withColumn("_place", place).where(F.col("_place") <= n).join(wholes, mine)
        return top.select(*by, "issue_type", "count", percent(F.col("count"), F.col("_runs")).alias("pct"))
    whole = F.greatest(runs.select(F.count(F.lit(1))).scalar(), F.lit(1))
    return (
        _reported(findings)
        .groupBy(F.col("issue_id").alias("issue_type"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "issue_type")
        .limit(n)
        .withColumn("pct", percent(F.col("count"), whole))
    )


def score_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs per band: up to 40, 69, 84, and above; for everyone, or per owner or team in ``by``."""
    s = F.col("risk_score")
    return df.groupBy(*by).agg(
        F.count_if(s <= 40).alias("risky"),
        F.count_if((s > 40) & (s <= 69)).alias("review"),
        F.count_if((s > 69) & (s <= 84)).alias("caution"),
        F.count_if(s > 84).alias("safe"),
    )


def member_leaderboard(df: DataFrame, member: str = "member", by: Sequence[str] = ()) -> DataFrame:
    """Runs, pass rate and mean score per member; best first."""
    n = F.col("validations")
    return (
        df.groupBy(*by, F.col(member).alias("member"))
        .agg(
            F.count(F.lit(1)).alias("validations"),
            F.count_if(_clean()).alias("_clean"),
            total(F.col("risk_score").cast("bigint")).alias("_score"),
        )
        .select(
            *by, "member", "validations", percent(F.col("_clean"), n).alias("pass_rate"),
            rounded_mean(F.col("_score"), n).alias("avg_score"),
        )
        .orderBy(*by, F.desc("pass_rate"), F.desc("avg_score"), "member")
    )


def member_attribution(df: DataFrame, users: DataFrame, members: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Recent runs of team members with the member's e-mail: the team's entry, else the user's, else 'unknown'.

    ``members`` is unique on (team_id, user_id), ``users`` on user_id. The two
    dimensions grow with the user base, so the join method is left to the
    optimizer's size estimate.
    """
    people = members.select("team_id", "user_id", F.col("email").alias("_team_email")).join(
        users.select("user_id", F.col("email").alias("_user_email")), "user_id", "left"
    )
    named = people.select(
        "user_id",
        "team_id",
        F.coalesce(F.nullif("_team_email", F.lit("")), F.nullif("_user_email", F.lit("")), F.lit("unknown")).alias("member"),
    )
    recent = df.where(F.col("created_at") >= days_before(naive(as_of), days)).drop("team_id")
    return recent.join(named, "user_id")


def team_overview(df: DataFrame, findings: DataFrame, team: str = "team_id", member: str = "member") -> DataFrame:
    """Per team: runs, mean score, most common issue, lowest-ranked member.

    Extremes come from min_by/max_by over small aggregates, no sort.
    """
    board = member_leaderboard(df, member, [team])
    last = F.max_by("member", F.struct(-F.col("pass_rate"), -F.col("avg_score"), F.col("member")))
    issues = (
        _reported(findings)
        .groupBy("query_id", "issue_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(df.select(F.col("id").alias("query_id"), team), "query_id")
        .groupBy(team, "issue_id")
        .agg(F.sum("n").alias("n"))
    )
    common = F.min_by("issue_id", F.struct(-F.col("n"), F.col("issue_id")))
    base = df.groupBy(team).agg(F.count(F.lit(1)).alias("total"), total(F.col("risk_score").cast("bigint")).alias("_s"))
    return (
        base.join(issues.groupBy(team).agg(common.alias("most_common_issue")), team, "left")
        .join(board.groupBy(team).agg(last.alias("lowest_member")), team, "left")
        .select(
            team, "total", rounded_mean(F.col("_s"), F.col("total")).alias("avg_score"), "most_common_issue",
            "lowest_member",
        )
    )


def risky_log(df: DataFrame, findings: DataFrame, n: int = 20, below: int = 70, by: Sequence[str] = ()) -> DataFrame:
    """Newest runs under a score, with their first error or else first warning.

    The runs are picked first, so the findings are only semi-filtered by their ids. With ``by``, the newest n of
    each owner or team: the limit of a rank is applied in every task before rows move, so a large team costs no more.
    """
    low = df.where(F.col("risk_score") < below)
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("created_at"), "id"))
        runs = low.withColumn("_place", place).where(F.col("_place") <= n)
        ids = runs.select(F.col("id").alias("query_id"))
    else:
        runs = low.orderBy(F.desc("created_at"), "id").limit(n)
        ids = F.broadcast(runs.select(F.col("id").alias("query_id")))  # n rows at most
    rank = F.when(F.col("severity") == "error", 0).otherwise(1)
    first = (
        _reported(findings)
        .join(ids, "query_id", "left_semi")
        .groupBy("query_id")
        .agg(F.min_by("issue_id", F.struct(rank, "seq", "issue_id")).alias("top_issue"))
    )
    return runs.join(first, F.col("id") == F.col("query_id"), "left").select(
        *by, "id", "user_id", "risk_score", "created_at", F.coalesce("top_issue", F.lit("—")).alias("top_issue")
    )


def period_digest(df: DataFrame, findings: DataFrame, as_of: str, days: int = 7, top: int = 3) -> DataFrame:
    """Per user: this period against the one before, and the most frequent issues of this period.

    One pass for all users; the reference point is ``as_of``. Runs are cut to the two periods where they are read,
    and findings meet the runs of this period before they are counted.
    """
    start, before = days_before(naive(as_of), days), days_before(naive(as_of), 2 * days)
    at = F.col("created_at")
    both = df.where((at >= before) & (at <= naive(as_of)))
    now = at >= start
    score = F.col("risk_score").cast("bigint")
    sums = both.groupBy("user_id").agg(
        F.count_if(now).alias("total"),
        F.count_if(now & _has_error()).alias("with_errors"),
        total(F.when(now, score)).alias("_s"),
        F.count_if(~now).alias("_prev_n"),
        total(F.when(~now, score)).alias("_prev_s"),
    )
    # Counts per (user, issue) are at most one row per issue id and user, so the window stays small.
    counts = (
        _reported(findings)
        .join(both.where(now).select(F.col("id").alias("query_id"), "user_id"), "query_id")
        .groupBy("user_id", "issue_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "issue_id"))
    tops = (
        counts.withColumn("place", place)
        .where(F.col("place") <= top)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", "issue_id", "n"))).alias("_top"))
    )
    return (
        sums.join(tops, "user_id", "left")
        .withColumn("avg_score", rounded_mean(F.col("_s"), F.col("total")))
        .withColumn("prev_avg_score", rounded_mean(F.col("_prev_s"), F.col("_prev_n")))
        .select(
            "user_id", "total", "with_errors", "avg_score", "prev_avg_score",
            (F.col("avg_score") - F.col("prev_avg_score")).alias("score_trend"),
            F.coalesce(F.transform("_top", lambda x: F.struct(x.issue_id.alias("issue_type"), x.n.alias("count"))), F.array()).alias("top_issues"),
        )
    )


def certification(
    df: DataFrame, findings: DataFrame, as_of: str, days: int = 30, runs: int = 100, score: int = 85
) -> DataFrame:
    """Per user over the last days: enough runs, a high mean score, no destructive finding."""
    recent = df.where(
        (F.col("created_at") >= days_before(naive(as_of), days)) & (F.col("created_at") <= naive(as_of))
    )
    destructive = findings.where((F.col("severity") == "error") & F.col("issue_id").isin(*DESTRUCTIVE)).select("query_id")
    bad = destructive.join(recent.select(F.col("id").alias("query_id")), "query_id", "left_semi").distinct()
    flagged = recent.join(bad.withColumn("_bad", F.lit(1)), F.col("id") == F.col("query_id"), "left")
    n = F.col("validations")
    return (
        flagged.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("validations"),
            total(F.col("risk_score").cast("bigint")).alias("_s"),
            F.count("_bad").alias("destructive_runs"),
        )
        .withColumn("avg_score", rounded_mean(F.col("_s"), n))
        .select(
            "user_id", "validations", "avg_score", "destructive_runs",
            ((n >= runs) & (F.col("avg_score") >= score) & (F.col("destructive_runs") == 0)).alias("certified"),
        )
    )


def audit_rollup(df: DataFrame, team: str, ts: str, kind: str, user: str) -> DataFrame:
    """Audit events per team, day and kind, with distinct users and the last event."""
    return df.groupBy(F.col(team).alias("team"), F.col(ts).cast("date").alias("day"), F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(user).alias("users"), F.max(ts).alias("last_event")
    )
