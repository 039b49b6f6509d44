"""Governance jobs on tables: usage, quotas, subscriptions, approvals, visibility, retention, erasure, alerts.

Tables are immutable snapshots: an upsert or purge returns the next snapshot, and the caller writes it to a new
place. Purging and erasing can also be written back to tables of ``sources.snapshots``, file by file.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainguard.operators.times import days_before, naive
from grainguard.plans.shapes import dealt, ratio, salted_left_join, total
from grainguard.plans.sorted_chunks import any_over_limit, exact_ranks
from grainguard.session import cut
from grainguard.sources.snapshots import ACTION, ALTER, DROP, KEEP, write_back
from grainguard.sources.snapshots import read as read_snapshot


def _month(ts: str | Column) -> Column:
    return F.trunc((F.col(ts) if isinstance(ts, str) else ts).cast("date"), "month")


# ---------------------------------------------------------------- usage and quotas


def monthly_usage(runs: DataFrame, as_of: str | None = None) -> DataFrame:
    """Validation and sandbox runs per user and calendar month; with ``as_of`` only the month it lies in."""
    if as_of is not None:
        runs = runs.where(_month("created_at") == _month(naive(as_of)))
    return runs.groupBy("user_id", _month("created_at").alias("month")).agg(
        F.count_if(F.col("kind") == "validation").alias("validations"),
        F.count_if(F.col("kind") == "sandbox").alias("sandbox_runs"),
    )


# Runs per month in the app (only the free plan is limited) and calls per month of the API.
FREE_VALIDATIONS = {"free": 50}
FREE_SANDBOX_RUNS = {"free": 5}
API_CALLS = {"free": 50, "pro": 1_000, "team": 10_000, "business": 100_000}


def quota_gate(
    runs: DataFrame, plans: DataFrame, limits: Mapping[str, int], unknown_as: str | None = "free"
) -> DataFrame:
    """Accept the first runs of a user and month up to the plan's limit; runs are (id, user_id, created_at).

    A plan without a limit is unlimited; an unknown plan counts as ``unknown_as``.
    Most users stay under their limit and are settled by counts alone. Only the
    runs of users over it are ranked, across chunks, so one caller with a third
    of all runs is not ranked in one task.
    """
    known = F.col("plan").isin(*limits) if unknown_as is not None else F.lit(True)
    plan = F.when(known, F.col("plan")).otherwise(F.lit(unknown_as))
    allowed = F.lit(None).cast("bigint")
    for name, n in limits.items():
        allowed = F.when(plan == name, F.lit(n).cast("bigint")).otherwise(allowed)
    by_month = runs.select("id", "user_id", "created_at", _month("created_at").alias("month"))
    counts = by_month.groupBy("user_id", "month").agg(F.count(F.lit(1)).alias("n"))
    over = (
        counts.join(plans.select("user_id", "plan"), "user_id", "left")
        .withColumn("allowed", allowed)
        .where(F.col("n") > F.col("allowed"))
        .select("user_id", "month", "allowed", "n")
    )
    marked = by_month.join(over.drop("n"), ["user_id", "month"], "left")
    hot = any_over_limit(over, "n")
    within = marked.where("allowed IS NULL").select("id", "user_id", "month", F.lit(True).alias("accepted"))
    ranked = exact_ranks(
        marked.where("allowed IS NOT NULL"), ["user_id", "month"], "created_at", "id", kinds=["row_number"], hot=hot
    )
    return within.unionByName(
        ranked.select("id", "user_id", "month", (F.col("row_number") <= F.col("allowed")).alias("accepted"))
    )


def _token_hash(token: str) -> Column:
    return F.sha2(F.col(token).cast("string").cast("binary"), 256)


def attribute_requests(requests: DataFrame, keys: DataFrame, token: str = "token") -> DataFrame:
    """Add the user of each request by the SHA-256 of its token; unknown and revoked keys are rejected.

    ``keys`` is unique on key_hash. One token may make a third of all requests, so requests are salted and the narrow
    keys copied to each salt.
    """
    live = keys.select("key_hash", "user_id", "revoked_at")
    hashed = requests.withColumn("key_hash", _token_hash(token))
    ok = F.col("user_id").isNotNull() & F.col("revoked_at").isNull()
    return (
        salted_left_join(hashed, live, "key_hash")
        .withColumn("accepted", ok)
        .withColumn("user_id", F.when(ok, F.col("user_id")))
        .drop("revoked_at", token)
    )


def key_last_use(requests: DataFrame, keys: DataFrame, ts: str, token: str = "token") -> DataFrame:
    """Last accepted use and number of uses per live key; requests are folded per token before the join."""
    calls = (
        requests.groupBy(token)
        .agg(F.max(ts).alias("last_used_at"), F.count(F.lit(1)).alias("calls"))
        .select(_token_hash(token).alias("key_hash"), "last_used_at", "calls")
    )
    return calls.join(keys.where("revoked_at IS NULL").select("key_hash"), "key_hash", "left_semi")


# Plans in order of precedence.
PAID_PLANS = ("pro", "team", "business")


def plan_from_price(df: DataFrame, price: str, lists: Mapping[str, str]) -> DataFrame:
    """Plan of a price id from comma-separated id lists; entries are trimmed, earlier plans win, default free."""
    plan = F.lit("free")
    for name in reversed(PAID_PLANS):
        ids = [x.strip() for x in lists.get(name, "").split(",") if x.strip()]
        if ids:
            plan = F.when(F.col(price).isin(*ids), name).otherwise(plan)
    return df.withColumn("plan", plan)


# ---------------------------------------------------------------- subscriptions


def subscription_state(events: DataFrame) -> DataFrame:
    """Latest plan, status and payment per user from (user_id, ts, id, kind, plan) events.

    created/updated set plan and status, deleted returns to free, a failed payment
    keeps the plan, a successful one restarts the usage period.
    """
    kind = F.col("kind")
    change = kind.isin("subscription.created", "subscription.updated")
    gone = kind == "subscription.deleted"
    at = F.struct("ts", "id")

    def latest(value: Column, when: Column) -> Column:
        return F.max_by(F.when(when, value), F.when(when, at))

    status = (
        F.when(change, "active").when(gone, "canceled").when(kind == "payment.failed", "past_due").otherwise("active")
    )
    paid = kind == "payment.succeeded"
    return events.groupBy("user_id").agg(
        F.coalesce(latest(F.when(gone, "free").otherwise(F.col("plan")), change | gone), F.lit("free")).alias("plan"),
        latest(status, change | gone | paid | (kind == "payment.failed")).alias("status"),
        F.max(F.when(paid, F.col("ts"))).alias("usage_reset_at"),
    )


def usage_since_reset(runs: DataFrame, state: DataFrame, as_of: str) -> DataFrame:
    """Runs per user since the later of the month's start and the last successful payment."""
    start = _month(naive(as_of)).cast("timestamp_ntz")
    recent = runs.where((F.col("created_at") >= start) & (F.col("created_at") <= naive(as_of)))
    since = F.greatest(start, F.col("usage_reset_at"))
    return (
        salted_left_join(recent.select("user_id", "created_at"), state.select("user_id", "usage_reset_at"), "user_id")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("runs_this_month"),
            F.count_if(F.col("created_at") >= since).alias("runs_since_reset"),
        )
    )


# ---------------------------------------------------------------- approvals, visibility, membership

APPROVAL_BELOW = 70  # Fixed value: runs under this score need approval.


def approval_backlog(requests: DataFrame, decisions: DataFrame, as_of: str, below: int = APPROVAL_BELOW) -> DataFrame:
    """Per team: pending, approved, rejected, age of the oldest pending request, mean hours to decision.

    ``requests`` is (id, team_id, risk_score, created_at); ``decisions`` is
    (request_id, decision, decided_at, decision_id), the latest one counts.
    """
    at = F.struct("decided_at", "decision_id")
    latest = decisions.groupBy(F.col("request_id").alias("id")).agg(
        F.max_by("decision", at).alias("decision"), F.max("decided_at").alias("decided_at")
    )
    hours = F.timestamp_diff("SECOND", F.col("created_at"), F.col("decided_at")) / F.lit(3600.0)
    pending = F.col("decision").isNull()
    needed = requests.where(F.col("risk_score") < below).select("id", "team_id", "created_at")
    return (
        needed.join(latest, "id", "left")
        .groupBy("team_id")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(pending).alias("pending"),
            F.count_if(F.col("decision") == "approved").alias("approved"),
            F.count_if(F.col("decision") == "rejected").alias("rejected"),
            F.min(F.when(pending, F.col("created_at"))).alias("oldest_pending"),
            F.avg(hours).alias("mean_hours_to_decision"),
        )
        .withColumn(
            "oldest_pending_hours",
            F.timestamp_diff("HOUR", F.col("oldest_pending"), naive(as_of)),
        )
    )


def row_visibility(rows: DataFrame, members: DataFrame, user=None) -> DataFrame:
    """Rows (id, owner_id, team_id, shared) a user may read, and whether they may change them: own rows in full, shared
    rows of the user's teams read-only.

    For one ``user``: those rows with ``can_change``; one scan, no join result wider than the rows themselves. For all
    users (None): each row once per audience, with ``owner`` the user who owns it (NULL for a group) and ``group_id`` the
    group of ``visibility_groups`` that reads it (NULL for an owner). Users who are in the same teams read the same
    rows, so rows meet groups and never users; an owner who is in such a group keeps the right to change.
    """
    if user is None:
        own = rows.where(F.col("owner_id").isNotNull()).withColumns(
            {"owner": F.col("owner_id"), "group_id": F.lit(None).cast(members.schema["user_id"].dataType), "can_change": F.lit(True)}
        )
        teams = members.join(visibility_groups(members).select("group_id").distinct(), F.col("user_id") == F.col("group_id"), "left_semi")
        teams = teams.select("team_id", F.col("user_id").alias("group_id")).distinct()
        shared = rows.where("shared").join(teams, "team_id").select(*rows.columns, "group_id")
        return own.unionByName(shared.withColumn("can_change", F.lit(False)), allowMissingColumns=True)
    teams = members.where(F.col("user_id") == F.lit(user)).select("team_id").distinct()
    own = rows.where(F.col("owner_id") == F.lit(user)).withColumn("can_change", F.lit(True))
    foreign = rows.where("shared").where(F.col("owner_id").isNull() | (F.col("owner_id") != F.lit(user)))
    return own.unionByName(foreign.join(teams, "team_id", "left_semi").withColumn("can_change", F.lit(False)))


def visibility_groups(members: DataFrame) -> DataFrame:
    """(user_id, group_id): users who are in exactly the same teams share a group, named by its least user.

    A set of teams is compared by its size and 128 bits that are combined map-side (XOR and sum of hashes), so nobody's
    teams are gathered. Seats without a user or a team are none; users without a seat have no group.
    """
    seats = members.where(F.col("user_id").isNotNull() & F.col("team_id").isNotNull()).select("user_id", "team_id").distinct()
    sets = seats.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("team_id")).alias("a"),
        F.sum(F.xxhash64(F.lit(1), "team_id").cast("decimal(38,0)")).alias("b"),
    )
    groups = sets.groupBy("n", "a", "b").agg(F.min("user_id").alias("group_id"))
    return sets.join(groups, ["n", "a", "b"]).select("user_id", "group_id")


def visibility_counts(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Per user: own rows and foreign shared rows they can read, and teams they may manage.

    Shared rows are counted per team before members are joined, so no row meets every member of its team.
    """
    seats = members.select("team_id", "user_id", F.col("role").isin("owner", "manager").alias("manages"))
    per_team = rows.where("shared").groupBy("team_id").agg(F.count(F.lit(1)).alias("shared_rows"))
    own_shared = (
        rows.where("shared")
        .groupBy("team_id", F.col("owner_id").alias("user_id"))
        .agg(F.count(F.lit(1)).alias("own_shared"))
    )
    foreign = (
        seats.join(per_team, "team_id", "left")
        .join(own_shared, ["team_id", "user_id"], "left")
        .groupBy("user_id")
        .agg(
            total(F.coalesce("shared_rows", F.lit(0)) - F.coalesce("own_shared", F.lit(0))).alias("team_rows"),
            F.count_if("manages").alias("teams_managed"),
        )
    )
    own = rows.groupBy(F.col("owner_id").alias("user_id")).agg(F.count(F.lit(1)).alias("own_rows"))
    return (
        own.join(foreign, "user_id", "full_outer")
        .fillna(0, ["own_rows", "team_rows", "teams_managed"])
        .withColumn("visible_rows", F.col("own_rows") + F.col("team_rows"))
    )


def membership_upsert(members: DataFrame, accepts: DataFrame, invites: DataFrame) -> DataFrame:
    """Members after a batch of accepted invitations: next snapshot of (team_id, user_id, role, email, joined_at).

    A token must exist and not be expired when it is used; a seat that is taken
    stays as it is; of several acceptances of one seat the first counts.
    """
    valid = accepts.join(invites.select("token", "team_id", "role", "expires_at"), "token").where(
        F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("accepted_at"))
    )
    first = F.min_by(F.struct("role", "email", "accepted_at"), F.struct("accepted_at", "token"))
    seats = (
        valid.join(members.select("team_id", "user_id"), ["team_id", "user_id"], "left_anti")
        .groupBy("team_id", "user_id")
        .agg(first.alias("s"))
        .select(
            "team_id", "user_id", F.col("s.role").alias("role"), F.lower(F.trim("s.email")).alias("email"),
            F.col("s.accepted_at").alias("joined_at"),
        )
    )
    return members.select(*seats.columns).unionByName(seats)


def mark_accepted(invites: DataFrame, accepts: DataFrame) -> DataFrame:
    """Invitations with the time of their first valid use."""
    used = accepts.join(invites.select("token", "expires_at"), "token").where(
        F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("accepted_at"))
    )
    marks = used.groupBy("token").agg(F.min("accepted_at").alias("_mark"))
    return (
        invites.join(marks, "token", "left")
        .withColumn("accepted_at", F.coalesce("accepted_at", "_mark"))
        .drop("_mark")
    )


def team_of_user(members: DataFrame) -> DataFrame:
    """One team per user: the first they joined."""
    return members.groupBy("user_id").agg(F.min_by("team_id", F.struct("joined_at", "team_id")).alias("team_id"))


# ---------------------------------------------------------------- retention and erasure

# Category, how long it is kept, and whether only the free plan is purged.
RETENTION = (
    ("history", "12 MONTHS", True),
    ("links", "30 DAYS", False),
    ("logs", "90 DAYS", False),
    ("credentials", "7 DAYS", False),
    ("payments", "84 MONTHS", False),
)


def retention_purge(df: DataFrame, holds: DataFrame, as_of: str, policy: Sequence[tuple] = RETENTION) -> DataFrame:
    """Mark rows (user_id, category, plan, created_at) 'keep' or 'purge'; legal holds and unlisted categories keep.

    The policy is a handful of fixed lines, so it is a condition and not a join.
    """
    due = F.lit(False)
    for category, age, free_only in policy:
        old = F.col("created_at") < naive(as_of) - F.expr(f"INTERVAL {age}")
        if free_only:
            old = old & (F.col("plan") == "free")
        due = F.when(F.col("category") == category, old).otherwise(due)
    held = holds.select("user_id", F.lit(True).alias("_held")).distinct()
    purge = F.coalesce(due, F.lit(False)) & F.col("_held").isNull()
    return (
        df.join(held, "user_id", "left")
        .withColumn("action", F.when(purge, "purge").otherwise("keep"))
        .drop("_held")
    )


def purge_table(spark: SparkSession, root: str, holds: DataFrame, as_of: str, policy: Sequence[tuple] = RETENTION) -> dict:
    """``retention_purge`` written back to a snapshot table: files with a row to purge are rewritten without it."""

    def change(rows: DataFrame) -> DataFrame:
        marked = retention_purge(rows, holds, as_of, policy)
        return marked.withColumn(ACTION, F.when(F.col("action") == "purge", DROP).otherwise(KEEP))

    return write_back(spark, root, change)


def erase_from_tables(spark: SparkSession, tables: Mapping[str, tuple], requests: DataFrame) -> dict[str, dict]:
    """``erase_accounts`` written back: files with rows of users who asked for it are rewritten without them, or with the
    owner set to NULL.

    ``tables`` maps a name to ("delete", root, user column), ("anonymise", root, user column) or ("cascade", root,
    parent id, parent table name, parent key). What hangs on a table goes before it, so a run that dies halfway still
    finds the parents and can be repeated.
    """
    gone = cut(requests.select(F.col("user_id").alias("_gone")).where("_gone IS NOT NULL").distinct())

    def marked(rows: DataFrame, column: str, ids: DataFrame, action: str) -> DataFrame:
        rows, ids = dealt(rows, column, ids, "_gone")
        found = rows.join(ids.select(F.col("_gone").alias("_id"), F.lit(action).alias("_hit")), F.col(column) == F.col("_id"), "left")
        return found.withColumn(ACTION, F.coalesce("_hit", F.lit(KEEP)))

    def change(how: str, args: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
        if how == "delete":
            return lambda rows: marked(rows, args[0], gone, DROP)
        if how == "anonymise":
            return lambda rows: marked(rows, args[0], gone, ALTER).withColumn(args[0], F.when(F.col(ACTION) == KEEP, F.col(args[0])))
        parent_id, parent, parent_key = args
        _, parent_root, user = tables[parent]
        parents, users = dealt(read_snapshot(spark, parent_root).select(parent_key, user), user, gone, "_gone")
        lost = cut(parents.join(users, F.col(user) == F.col("_gone"), "left_semi").select(F.col(parent_key).alias("_gone")).distinct())
        return lambda rows: marked(rows, parent_id, lost, DROP)

    order = sorted(tables, key=lambda name: tables[name][0] != "cascade")
    return {name: write_back(spark, tables[name][1], change(tables[name][0], tables[name][2:])) for name in order}


def link_expiry(df: DataFrame, as_of: str) -> DataFrame:
    """Live links (expires_at) with whole days left, rounded up; expired links are not found."""
    seconds = F.timestamp_diff("MICROSECOND", naive(as_of), F.col("expires_at")) / F.lit(1e6)
    left = F.greatest(F.lit(0), F.ceil(seconds / 86400)).cast("bigint")
    live = F.col("expires_at").isNull() | (F.col("expires_at") >= naive(as_of))
    return df.where(live).withColumn("days_left", left)


def erase_rows(df: DataFrame, user: str, requests: DataFrame) -> DataFrame:
    """Rows left after deleting those of users who asked for it."""
    gone = requests.select(F.col("user_id").alias("_gone")).distinct()
    return df.join(gone, F.col(user) == F.col("_gone"), "left_anti")


def erase_owned(df: DataFrame, parent_id: str, parents: DataFrame, parent_key: str, user: str, requests: DataFrame) -> DataFrame:
    """Cascade: rows left after deleting those whose parent belonged to such a user."""
    gone = requests.select(F.col("user_id").alias("_gone")).distinct()
    lost = parents.join(gone, F.col(user) == F.col("_gone"), "left_semi").select(F.col(parent_key).alias("_lost"))
    return df.join(lost, F.col(parent_id) == F.col("_lost"), "left_anti")


def anonymise_rows(df: DataFrame, user: str, requests: DataFrame) -> DataFrame:
    """All rows, with the owner set to NULL where that user asked for erasure."""
    gone = requests.select(F.col("user_id").alias("_gone")).distinct()
    return (
        df.join(gone, F.col(user) == F.col("_gone"), "left")
        .withColumn(user, F.when(F.col("_gone").isNull(), F.col(user)))
        .drop("_gone")
    )


def erase_accounts(
    tables: Mapping[str, tuple], requests: DataFrame, as_of: str
) -> dict[str, DataFrame]:
    """All tables after a batch of deletion requests, and the deletion log.

    ``tables`` maps a name to ("delete", df, user column), ("anonymise", df, user
    column) or ("cascade", df, parent id, parent table name, parent key).
    """
    out = {}
    for name, (how, df, *args) in tables.items():
        if how == "delete":
            out[name] = erase_rows(df, args[0], requests)
        elif how == "anonymise":
            out[name] = anonymise_rows(df, args[0], requests)
        else:
            parent_id, parent, parent_key = args
            _, parent_df, user = tables[parent]
            out[name] = erase_owned(df, parent_id, parent_df, parent_key, user, requests)
    out["account_deletions"] = requests.select("user_id").distinct().withColumn("deleted_at", naive(as_of))
    return out


# ---------------------------------------------------------------- digests, notices, alerts


def due_digests(prefs: DataFrame, digests: DataFrame, as_of: str, min_age_days: int = 6) -> DataFrame:
    """Digests of subscribers who are due: frequency not 'never' and nothing sent for more than six days."""
    due = prefs.where(
        (F.col("frequency") != "never")
        & (F.col("last_sent_at").isNull() | (F.col("last_sent_at") < days_before(naive(as_of), min_age_days)))
    )
    return due.select("user_id", "frequency").join(digests, "user_id")


def notify_once(recipients: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Recipients without a sent mark, each once."""
    return recipients.dropDuplicates([key]).join(sent.select(key).distinct(), key, "left_anti")


def mark_sent(sent: DataFrame, delivered: DataFrame, key: str, as_of: str) -> DataFrame:
    """Marks after a batch: next snapshot of (key, sent_at)."""
    return sent.unionByName(delivered.select(key).withColumn("sent_at", naive(as_of)))


def fires(trigger: Column, errors: Column, warnings: Column) -> Column:
    """Does a webhook with these triggers fire for a report with these counts?"""
    wanted = F.coalesce(trigger, F.array(F.lit("error")))
    return (
        F.array_contains(wanted, "all")
        | (F.array_contains(wanted, "error") & (errors > 0))
        | (F.array_contains(wanted, "warning") & ((errors > 0) | (warnings > 0)))
    )


def route_alerts(reports: DataFrame, configs: DataFrame, owner: str) -> DataFrame:
    """(report, webhook) pairs that fire; every pair is one delivery to make. Inactive webhooks never fire."""
    live = configs.where(F.coalesce("active", F.lit(True))).select(owner, "webhook_id", "trigger_on")
    hit = fires(F.col("trigger_on"), F.col("error_count"), F.col("warning_count"))
    return reports.select("id", owner, "error_count", "warning_count").join(live, owner).where(hit).select("id", "webhook_id")


def delivery_rollup(log: DataFrame) -> DataFrame:
    """Per webhook: delivered (HTTP 200-299) and failed attempts, failure share, last success."""
    ok = (F.col("http_status") >= 200) & (F.col("http_status") < 300)
    return (
        log.groupBy("webhook_id")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count_if(ok).alias("delivered"),
            F.count_if(~ok).alias("failed"),
            F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        )
        .withColumn("failure_share", ratio("failed", "attempts"))
    )
