"""Governance jobs on validations, deliveries and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainguard.bindings.history import PERIOD_SQL, digest_text
from grainguard.bindings.joins import _round
from grainguard.bindings.registry import bind
from grainguard.operators import governance as G
from grainguard.operators.claims import claim_events
from grainguard.operators.history import period_digest
from grainguard.session import new_folder
from grainguard.sources import snapshots
from grainguard.sources.tables import AS_OF

_RUNS_SQL = """
    runs AS (SELECT id, user_id, created_at, CASE WHEN error_count > 0 THEN 'sandbox' ELSE 'validation' END AS kind
             FROM validations)"""


def _runs(t):
    return t.validations.select(
        "id", "user_id", "created_at", F.when(F.col("error_count") > 0, "sandbox").otherwise("validation").alias("kind")
    )


def _month_text(df):
    return df.withColumn("month", F.date_format("month", "yyyy-MM"))


_USAGE_SQL = """
    SELECT user_id, strftime(created_at, '%Y-%m') AS month, COUNT(*) FILTER (WHERE kind = 'validation') AS validations,
           COUNT(*) FILTER (WHERE kind = 'sandbox') AS sandbox_runs FROM runs"""


@bind("monthly_usage", f"WITH {_RUNS_SQL} {_USAGE_SQL} GROUP BY 1, 2")
def _(t):
    return _month_text(G.monthly_usage(_runs(t)))


@bind(
    "monthly_usage_live",
    f"WITH {_RUNS_SQL} {_USAGE_SQL} WHERE strftime(created_at, '%Y-%m') = '2001-07' GROUP BY 1, 2",
)
def _(t):
    return _month_text(G.monthly_usage(_runs(t), "2001-07-20 00:00:00"))


_PLANS_SQL = """
    plans AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'team'
                       WHEN 'FURNITURE' THEN 'legacy' ELSE 'free' END AS plan FROM customer)"""


def _plans(t):
    plan = (
        F.when(F.col("c_mktsegment") == "BUILDING", "pro")
        .when(F.col("c_mktsegment") == "MACHINERY", "team")
        .when(F.col("c_mktsegment") == "FURNITURE", "legacy")
        .otherwise("free")
    )
    return t.customer.select(F.col("c_custkey").alias("user_id"), plan.alias("plan"))


def _quota(source, limits, default):
    cases = " ".join(f"WHEN '{p}' THEN {n}" for p, n in limits.items())
    return f"""
    WITH {_PLANS_SQL}, r AS ({source}),
         n AS (SELECT r.*, row_number() OVER (PARTITION BY r.user_id, date_trunc('month', created_at)
                                              ORDER BY created_at, id) AS rn, CASE plan {cases} ELSE {default} END AS allowed
               FROM r LEFT JOIN plans p ON p.user_id = r.user_id)
    SELECT id, user_id, strftime(created_at, '%Y-%m') AS month, COALESCE(rn <= allowed, TRUE) AS accepted FROM n"""


_CALLS = "SELECT event_id AS id, user_id, ts AS created_at FROM events"


@bind("quota_gate", _quota(_CALLS, G.API_CALLS, 50))
def _(t):
    calls = t.events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"))
    return _month_text(G.quota_gate(calls, _plans(t), G.API_CALLS))


@bind("quota_gate_free_only", _quota("SELECT id, user_id, created_at FROM validations", {"free": 1}, "NULL"))
def _(t):
    return _month_text(G.quota_gate(t.validations, _plans(t), {"free": 1}, unknown_as=None))


_KEYS_SQL = """
    keys AS (SELECT CASE WHEN c_mktsegment <> 'FURNITURE' THEN sha256(CAST(c_custkey AS VARCHAR)) END AS key_hash, c_custkey AS user_id,
                    CASE WHEN c_mktsegment = 'MACHINERY' THEN TIMESTAMP '2024-01-01 00:00:00' END AS revoked_at
             FROM customer),
    a AS (SELECT event_id, ts, sha256(CAST(events.user_id AS VARCHAR)) AS key_hash,
                 CASE WHEN revoked_at IS NULL THEN k.user_id END AS user_id,
                 k.user_id IS NOT NULL AND revoked_at IS NULL AS accepted
          FROM events LEFT JOIN keys k ON k.key_hash = sha256(CAST(events.user_id AS VARCHAR)))"""


def _requests(t):
    hashed = F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256)
    keys = t.customer.select(
        F.when(F.col("c_mktsegment") != "FURNITURE", hashed).alias("key_hash"),  # NULL: a user without a key
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("2024-01-01 00:00:00")).cast("timestamp_ntz").alias("revoked_at"),
    )
    return t.events.select("event_id", "ts", F.col("user_id").alias("token")), keys


@bind("attribute_requests", f"WITH {_KEYS_SQL} SELECT * FROM a")
def _(t):
    return G.attribute_requests(*_requests(t))


@bind(
    "key_last_use",
    f"WITH {_KEYS_SQL} SELECT key_hash, MAX(ts) AS last_used_at, COUNT(*) AS calls FROM a WHERE accepted GROUP BY 1",
)
def _(t):
    return G.key_last_use(*_requests(t), "ts")


_LISTS = {"pro": "Brand#4, Brand#7 ,Brand#23", "team": " Brand#7,Brand#17", "business": "Brand#11 , Brand#8,"}


@bind(
    "plan_from_price",
    """
    SELECT p_partkey, p_brand, CASE WHEN p_brand IN ('Brand#4', 'Brand#7', 'Brand#23') THEN 'pro'
                                    WHEN p_brand IN ('Brand#17') THEN 'team'
                                    WHEN p_brand IN ('Brand#11', 'Brand#8') THEN 'business' ELSE 'free' END AS plan FROM part""",
)
def _(t):
    return G.plan_from_price(t.part.select("p_partkey", "p_brand"), "p_brand", _LISTS)


def _claims(stale):
    return f"""
    WITH RECURSIVE
         o AS (SELECT *, row_number() OVER (PARTITION BY delivery_key ORDER BY ts, attempt) AS rn FROM deliveries),
         w AS (SELECT delivery_key, attempt, rn, 'processed' AS outcome, ts AS claimed, completed AS done FROM o WHERE rn = 1
               UNION ALL
               SELECT o.delivery_key, o.attempt, o.rn,
                      CASE WHEN w.done THEN 'duplicate' WHEN o.ts < w.claimed + INTERVAL {stale} THEN 'in_flight' ELSE 'reclaimed' END,
                      CASE WHEN w.done OR o.ts < w.claimed + INTERVAL {stale} THEN w.claimed ELSE o.ts END,
                      CASE WHEN w.done OR o.ts < w.claimed + INTERVAL {stale} THEN w.done ELSE o.completed END
               FROM w JOIN o ON o.delivery_key = w.delivery_key AND o.rn = w.rn + 1)
    SELECT delivery_key, attempt, outcome FROM w"""


@bind("claim_events", _claims("5 MINUTES"))
def _(t):
    return claim_events(t.deliveries, "delivery_key", "ts", "attempt", "completed", stale_seconds=300)


@bind("claim_events_two_days", _claims("2 DAYS"))
def _(t):
    return claim_events(t.deliveries, "delivery_key", "ts", "attempt", "completed", stale_seconds=2 * 86_400)


_STATE_SQL = """
    e AS (SELECT user_id, ts, attempt AS id, kind, CASE CAST(attempt % 3 AS INT) WHEN 0 THEN 'pro' WHEN 1 THEN 'team'
                   ELSE 'business' END AS plan FROM deliveries),
    state AS (SELECT user_id,
                COALESCE(ARG_MAX(CASE WHEN kind = 'subscription.deleted' THEN 'free' ELSE plan END, (ts, id))
                           FILTER (WHERE kind LIKE 'subscription.%'), 'free') AS plan,
                ARG_MAX(CASE kind WHEN 'subscription.deleted' THEN 'canceled' WHEN 'payment.failed' THEN 'past_due'
                             ELSE 'active' END, (ts, id)) AS status,
                MAX(ts) FILTER (WHERE kind = 'payment.succeeded') AS usage_reset_at FROM e GROUP BY 1)"""


def _state(t):
    plan = F.when(F.pmod("attempt", F.lit(3)) == 0, "pro").when(F.pmod("attempt", F.lit(3)) == 1, "team").otherwise("business")
    return G.subscription_state(
        t.deliveries.select("user_id", "ts", F.col("attempt").alias("id"), "kind", plan.alias("plan"))
    )


@bind("subscription_state", f"WITH {_STATE_SQL} SELECT * FROM state")
def _(t):
    return _state(t)


@bind(
    "usage_since_reset",
    f"""
    WITH {_STATE_SQL}
    SELECT r.user_id, COUNT(*) AS runs_this_month,
           COUNT(*) FILTER (WHERE r.ts >= GREATEST(TIMESTAMP '2024-01-01 00:00:00', usage_reset_at)) AS runs_since_reset
    FROM events r LEFT JOIN state ON state.user_id = r.user_id
    WHERE r.ts >= TIMESTAMP '2024-01-01 00:00:00' AND r.ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1""",
)
def _(t):
    runs = t.events.select("user_id", F.col("ts").alias("created_at"))
    return G.usage_since_reset(runs, _state(t), "2024-01-31 00:00:00")


# ---------------------------------------------------------------- approvals, visibility, membership


@bind(
    "approval_backlog",
    f"""
    WITH d AS (SELECT CASE WHEN l_quantity > 25 THEN l_orderkey END AS id, CASE l_returnflag WHEN 'R' THEN 'rejected' ELSE 'approved' END AS decision,
                      l_shipdate AS decided_at, l_returnflag || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS decision_id
               FROM lineitem),
         l AS (SELECT id, ARG_MAX(decision, (decided_at, decision_id)) AS decision, MAX(decided_at) AS decided_at FROM d GROUP BY 1),
         r AS (SELECT v.team_id, v.created_at, l.decision, date_diff('second', v.created_at, l.decided_at) / 3600 AS h
               FROM validations v LEFT JOIN l ON l.id = v.id WHERE v.risk_score < 70)
    SELECT team_id, COUNT(*) AS requests, COUNT(*) FILTER (WHERE decision IS NULL) AS pending,
           COUNT(*) FILTER (WHERE decision = 'approved') AS approved, COUNT(*) FILTER (WHERE decision = 'rejected') AS rejected,
           MIN(created_at) FILTER (WHERE decision IS NULL) AS oldest_pending, ROUND(AVG(h), 6) AS mean_hours_to_decision,
           date_diff('hour', MIN(created_at) FILTER (WHERE decision IS NULL), TIMESTAMP '{AS_OF}') AS oldest_pending_hours
    FROM r GROUP BY 1""",
)
def _(t):
    decisions = t.lineitem.select(
        F.when(F.col("l_quantity") > 25, F.col("l_orderkey")).alias("request_id"),  # NULL: decides no request
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("decision"),
        F.col("l_shipdate").alias("decided_at"),
        F.expr("l_returnflag || l_partkey || '-' || l_suppkey || '-' || l_linenumber").alias("decision_id"),
    )
    return _round(G.approval_backlog(t.validations, decisions, AS_OF), "mean_hours_to_decision")


_SHARED_SQL = """
    rows_ AS (SELECT id, user_id AS owner_id, team_id, warning_count > 0 AS shared FROM validations),
    members AS (SELECT CAST(c_custkey % 20 AS INT) AS team_id, c_custkey AS user_id,
                       CASE WHEN c_nationkey < 3 THEN 'owner' WHEN c_nationkey < 6 THEN 'manager' ELSE 'analyst' END AS role
                FROM customer
                UNION ALL SELECT CAST((c_custkey + 7) % 20 AS INT), c_custkey, 'analyst' FROM customer)"""


def _shared(t):
    rows = t.validations.select(
        "id", F.col("user_id").alias("owner_id"), "team_id", (F.col("warning_count") > 0).alias("shared")
    )
    role = F.when(F.col("c_nationkey") < 3, "owner").when(F.col("c_nationkey") < 6, "manager").otherwise("analyst")
    first = t.customer.select(
        F.expr("cast(c_custkey % 20 as int)").alias("team_id"), F.col("c_custkey").alias("user_id"), role.alias("role")
    )
    second = t.customer.select(
        F.expr("cast((c_custkey + 7) % 20 as int)").alias("team_id"), F.col("c_custkey").alias("user_id"),
        F.lit("analyst").alias("role"),
    )
    return rows, first.unionByName(second)


@bind(
    "row_visibility",
    f"""
    WITH {_SHARED_SQL}
    SELECT *, owner_id = 42 AS can_change FROM rows_
    WHERE owner_id = 42 OR (shared AND team_id IN (SELECT team_id FROM members WHERE user_id = 42))""",
)
def _(t):
    """What one viewer sees; the viewer is the operator's parameter."""
    return G.row_visibility(*_shared(t), 42)


_GROUPS_SQL = """
    sets AS (SELECT user_id, list(DISTINCT team_id ORDER BY team_id) AS teams FROM members GROUP BY 1),
    groups AS (SELECT user_id, MIN(user_id) OVER (PARTITION BY teams) AS group_id, teams FROM sets)"""


@bind("visibility_groups", f"WITH {_SHARED_SQL}, {_GROUPS_SQL} SELECT user_id, group_id FROM groups")
def _(t):
    return G.visibility_groups(_shared(t)[1])


@bind(
    "row_visibility_all",
    f"""
    WITH {_SHARED_SQL}, {_GROUPS_SQL}
    SELECT *, owner_id AS owner, CAST(NULL AS BIGINT) AS group_id, TRUE AS can_change FROM rows_ WHERE owner_id IS NOT NULL
    UNION ALL
    SELECT r.*, CAST(NULL AS BIGINT), group_id, FALSE FROM rows_ r JOIN groups g ON g.user_id = g.group_id AND r.team_id IN g.teams
    WHERE shared""",
)
def _(t):
    return G.row_visibility(*_shared(t))


@bind(
    "row_visibility_counts",
    f"""
    WITH {_SHARED_SQL},
         p AS (SELECT m.user_id, r.id, r.owner_id FROM members m JOIN rows_ r ON r.team_id = m.team_id AND shared),
         f AS (SELECT user_id, COUNT(*) AS team_rows FROM p WHERE owner_id <> user_id GROUP BY 1),
         g AS (SELECT user_id, COUNT(*) FILTER (WHERE role IN ('owner', 'manager')) AS teams_managed FROM members GROUP BY 1),
         o AS (SELECT owner_id AS user_id, COUNT(*) AS own_rows FROM rows_ GROUP BY 1),
         u AS (SELECT user_id FROM g UNION SELECT user_id FROM o)
    SELECT u.user_id, COALESCE(own_rows, 0) AS own_rows, COALESCE(team_rows, 0) AS team_rows,
           COALESCE(teams_managed, 0) AS teams_managed, COALESCE(own_rows, 0) + COALESCE(team_rows, 0) AS visible_rows
    FROM u LEFT JOIN o ON o.user_id = u.user_id LEFT JOIN f ON f.user_id = u.user_id LEFT JOIN g ON g.user_id = u.user_id""",
)
def _(t):
    return G.visibility_counts(*_shared(t))


_TEAMS_SQL = """
    members AS (SELECT CAST(c_custkey % 20 AS INT) AS team_id, c_custkey AS user_id, 'owner' AS role,
                       lower(c_name) AS email, TIMESTAMP '2023-06-01 00:00:00' AS joined_at
                FROM customer),
    invites AS (SELECT CASE WHEN event_type <> 'signup' THEN 'tok' || event_id END AS token, CAST(event_id % 20 AS INT) AS team_id,
                       CASE event_type WHEN 'view' THEN 'manager' ELSE 'analyst' END AS role,
                       CASE event_type WHEN 'error' THEN ts - INTERVAL 1 DAY WHEN 'click' THEN NULL ELSE ts + INTERVAL 1 DAY END AS expires_at,
                       CAST(NULL AS TIMESTAMP) AS accepted_at
                FROM events),
    accepts AS (SELECT 'tok' || event_id AS token, user_id, '  USER' || user_id || '@Mail.Example ' AS email, ts AS accepted_at
                FROM events),
    valid AS (SELECT a.*, i.team_id, i.role FROM accepts a JOIN invites i ON i.token = a.token
              WHERE i.expires_at IS NULL OR i.expires_at >= a.accepted_at),
    seats AS (SELECT team_id, user_id, role, lower(trim(email)) AS email, accepted_at AS joined_at FROM valid v
              WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.team_id = v.team_id AND m.user_id = v.user_id)
              QUALIFY row_number() OVER (PARTITION BY team_id, user_id ORDER BY accepted_at, token) = 1),
    next AS (SELECT * FROM members UNION ALL SELECT * FROM seats)"""


def _teams(t):
    members = t.customer.select(
        F.expr("cast(c_custkey % 20 as int)").alias("team_id"), F.col("c_custkey").alias("user_id"),
        F.lit("owner").alias("role"), F.lower("c_name").alias("email"),
        F.lit("2023-06-01 00:00:00").cast("timestamp_ntz").alias("joined_at"),
    )
    token = F.concat(F.lit("tok"), F.col("event_id").cast("string")).alias("token")
    kind = F.col("event_type")
    invites = t.events.select(
        F.when(kind != "signup", token).alias("token"),  # NULL: no invitation was sent
        F.expr("cast(event_id % 20 as int)").alias("team_id"),
        F.when(kind == "view", "manager").otherwise("analyst").alias("role"),
        F.when(kind == "error", F.col("ts") - F.expr("INTERVAL 1 DAY"))
        .when(kind != "click", F.col("ts") + F.expr("INTERVAL 1 DAY"))
        .alias("expires_at"),
        F.lit(None).cast("timestamp_ntz").alias("accepted_at"),
    )
    accepts = t.events.select(
        token, "user_id",
        F.concat(F.lit("  USER"), F.col("user_id").cast("string"), F.lit("@Mail.Example ")).alias("email"),
        F.col("ts").alias("accepted_at"),
    )
    return members, accepts, invites


@bind("membership_upsert", f"WITH {_TEAMS_SQL} SELECT * FROM next")
def _(t):
    return G.membership_upsert(*_teams(t))


@bind(
    "mark_accepted",
    f"""
    WITH {_TEAMS_SQL}
    SELECT token, (SELECT MIN(v.accepted_at) FROM valid v WHERE v.token = invites.token) AS accepted_at FROM invites""",
)
def _(t):
    _, accepts, invites = _teams(t)
    return G.mark_accepted(invites, accepts).select("token", "accepted_at")


@bind(
    "team_of_user",
    f"WITH {_TEAMS_SQL} SELECT user_id, ARG_MIN(team_id, (joined_at, team_id)) AS team_id FROM next GROUP BY 1",
)
def _(t):
    return G.team_of_user(G.membership_upsert(*_teams(t)))


# ---------------------------------------------------------------- retention and erasure

_KEPT_SQL = f"""
    {_PLANS_SQL},
    d AS (SELECT v.id, v.user_id, v.created_at, COALESCE(plan, 'free') AS plan,
                 CASE source WHEN 'manual' THEN 'history' WHEN 'cursor' THEN 'links' WHEN 'copilot' THEN 'logs'
                             WHEN 'chatgpt' THEN 'credentials' WHEN 'inhouse' THEN 'payments' ELSE 'account' END AS category
          FROM validations v LEFT JOIN plans p ON p.user_id = v.user_id),
    h AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')"""


_PURGED_SQL = f"""
    WITH {_KEPT_SQL}
    SELECT d.*, CASE WHEN user_id NOT IN (SELECT user_id FROM h) AND CASE category
               WHEN 'history' THEN plan = 'free' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTHS
               WHEN 'links' THEN created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS
               WHEN 'logs' THEN created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS
               WHEN 'credentials' THEN created_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS
               WHEN 'payments' THEN created_at < TIMESTAMP '{AS_OF}' - INTERVAL 84 MONTHS ELSE FALSE END
             THEN 'purge' ELSE 'keep' END AS action FROM d"""


def _kept(t):
    category = F.lit("account")
    for source, name in (("manual", "history"), ("cursor", "links"), ("copilot", "logs"), ("chatgpt", "credentials"), ("inhouse", "payments")):
        category = F.when(F.col("source") == source, name).otherwise(category)
    return t.validations.join(_plans(t), "user_id", "left").select(
        "id", "user_id", "created_at", F.coalesce("plan", F.lit("free")).alias("plan"), category.alias("category")
    )


@bind("retention_purge", _PURGED_SQL)
def _(t):
    return G.retention_purge(_kept(t), t.events.where("event_type = 'error'"), AS_OF)


@bind("retention_purge_written", f"SELECT * EXCLUDE (action) FROM ({_PURGED_SQL}) WHERE action = 'keep'")
def _(t):
    """Rows in the order they were made, so that old ones share files and the others' files stay as they are."""
    root = new_folder(t.spark, "kept")
    snapshots.create(_kept(t).repartitionByRange(8, "created_at"), root)
    G.purge_table(t.spark, root, t.events.where("event_type = 'error'"), AS_OF)
    return snapshots.read(t.spark, root)


@bind(
    "link_expiry",
    f"""
    SELECT id, created_at + INTERVAL 30 DAYS + INTERVAL 5 HOURS AS expires_at,
           CAST(GREATEST(0, CEIL(epoch(created_at + INTERVAL 30 DAYS + INTERVAL 5 HOURS - TIMESTAMP '{AS_OF}') / 86400)) AS BIGINT)
             AS days_left
    FROM validations WHERE created_at + INTERVAL 30 DAYS + INTERVAL 5 HOURS >= TIMESTAMP '{AS_OF}'""",
)
def _(t):
    links = t.validations.select("id", (F.col("created_at") + F.expr("INTERVAL '30 05' DAY TO HOUR")).alias("expires_at"))
    return G.link_expiry(links, AS_OF)


_GONE = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


def _erased(t):
    requests = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    tables = {
        "validations": ("delete", t.validations, "user_id"),
        "findings": ("cascade", t.findings, "query_id", "validations", "id"),
        "audit": ("anonymise", t.deliveries.select("attempt", "user_id", "kind"), "user_id"),
    }
    return G.erase_accounts(tables, requests, AS_OF)


@bind(
    "erase_accounts_written",
    f"""
    SELECT 'validations' AS table_name, id AS row_id, user_id FROM validations WHERE user_id NOT IN ({_GONE})
    UNION ALL SELECT 'findings', f.query_id, CAST(NULL AS BIGINT) FROM findings f
      WHERE f.query_id NOT IN (SELECT id FROM validations WHERE user_id IN ({_GONE}))
    UNION ALL SELECT 'audit', attempt, CASE WHEN user_id NOT IN ({_GONE}) THEN user_id END FROM deliveries""",
)
def _(t):
    requests = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    made = {"validations": t.validations, "findings": t.findings, "audit": t.deliveries.select("attempt", "user_id", "kind")}
    roots = {name: new_folder(t.spark, name) for name in made}
    for name, df in made.items():
        snapshots.create(df, roots[name])
    G.erase_from_tables(t.spark, {
        "validations": ("delete", roots["validations"], "user_id"),
        "findings": ("cascade", roots["findings"], "query_id", "validations", "id"),
        "audit": ("anonymise", roots["audit"], "user_id"),
    }, requests)
    left = {name: snapshots.read(t.spark, root) for name, root in roots.items()}
    nobody = F.lit(None).cast("long").alias("user_id")
    return (
        left["validations"].select(F.lit("validations").alias("table_name"), F.col("id").alias("row_id"), "user_id")
        .union(left["findings"].select(F.lit("findings"), "query_id", nobody))
        .union(left["audit"].select(F.lit("audit"), "attempt", "user_id"))
    )


@bind("erase_accounts", f"SELECT * FROM validations WHERE user_id NOT IN ({_GONE})")
def _(t):
    return _erased(t)["validations"]


@bind(
    "erase_accounts_cascade",
    f"SELECT * FROM findings WHERE query_id NOT IN (SELECT id FROM validations WHERE user_id IN ({_GONE}))",
)
def _(t):
    return _erased(t)["findings"]


@bind(
    "erase_accounts_audit",
    f"SELECT attempt, CASE WHEN user_id NOT IN ({_GONE}) THEN user_id END AS user_id, kind FROM deliveries",
)
def _(t):
    return _erased(t)["audit"]


@bind("erase_accounts_log", f"SELECT c_custkey AS user_id, TIMESTAMP '{AS_OF}' AS deleted_at FROM ({_GONE})")
def _(t):
    return _erased(t)["account_deletions"]


# ---------------------------------------------------------------- digests, notices, alerts

_PREFS_SQL = """
    prefs AS (SELECT c_custkey AS user_id,
                     CASE c_mktsegment WHEN 'BUILDING' THEN 'never' WHEN 'MACHINERY' THEN 'daily' ELSE 'weekly' END AS frequency,
                     CASE WHEN c_nationkey < 5 THEN NULL WHEN c_nationkey < 15 THEN TIMESTAMP '2001-07-20 00:00:00'
                          ELSE TIMESTAMP '2001-07-29 00:00:00' END AS last_sent_at FROM customer)"""


def _prefs(t):
    at = F.when(F.col("c_nationkey") >= 15, "2001-07-29 00:00:00").when(F.col("c_nationkey") >= 5, "2001-07-20 00:00:00")
    return t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "never")
        .when(F.col("c_mktsegment") == "MACHINERY", "daily")
        .otherwise("weekly")
        .alias("frequency"),
        at.cast("timestamp_ntz").alias("last_sent_at"),
    )


@bind(
    "due_digests",
    f"""
    WITH {PERIOD_SQL}, {_PREFS_SQL}
    SELECT d.*, frequency FROM d JOIN prefs ON prefs.user_id = d.user_id
    WHERE frequency <> 'never' AND (last_sent_at IS NULL OR last_sent_at < TIMESTAMP '{AS_OF}' - INTERVAL 6 DAYS)""",
)
def _(t):
    return digest_text(G.due_digests(_prefs(t), period_digest(t.validations, t.findings, AS_OF), AS_OF))


@bind(
    "notify_once",
    "SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
)
def _(t):
    recipients = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    return G.notify_once(recipients, t.events.select("user_id"), "user_id")


@bind(
    "mark_sent",
    """
    SELECT user_id, MIN(ts) AS sent_at FROM events GROUP BY 1
    UNION ALL SELECT c_custkey, TIMESTAMP '2024-02-01 00:00:00' FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
)
def _(t):
    sent = t.events.groupBy("user_id").agg(F.min("ts").alias("sent_at"))
    recipients = t.customer.select(F.col("c_custkey").alias("user_id"))
    return G.mark_sent(sent, G.notify_once(recipients, sent, "user_id"), "user_id", "2024-02-01 00:00:00")


_HOOKS_SQL = """
    hooks AS (SELECT c_custkey AS user_id, 'hook' || c_custkey AS webhook_id, c_nationkey <> 7 AS active,
                     CASE c_mktsegment WHEN 'BUILDING' THEN ['all'] WHEN 'MACHINERY' THEN ['warning']
                                       WHEN 'FURNITURE' THEN NULL ELSE ['error', 'other'] END AS trigger_on
              FROM customer
              UNION ALL SELECT c_custkey, 'second' || c_custkey, CASE WHEN c_nationkey >= 4 THEN FALSE END, ['warning', 'error'] FROM customer)"""


def hooks(t):
    segment = F.col("c_mktsegment")
    first = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("hook"), F.col("c_custkey").cast("string")).alias("webhook_id"),
        (F.col("c_nationkey") != 7).alias("active"),
        F.when(segment == "BUILDING", F.array(F.lit("all")))
        .when(segment == "MACHINERY", F.array(F.lit("warning")))
        .when(segment != "FURNITURE", F.array(F.lit("error"), F.lit("other")))
        .alias("trigger_on"),
    )
    second = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("second"), F.col("c_custkey").cast("string")).alias("webhook_id"),
        F.when(F.col("c_nationkey") >= 4, F.lit(False)).alias("active"),
        F.array(F.lit("warning"), F.lit("error")).alias("trigger_on"),
    )
    return first.unionByName(second)


ROUTED_SQL = f"""
    WITH {_HOOKS_SQL}
    SELECT v.id, webhook_id FROM validations v JOIN hooks h ON h.user_id = v.user_id
    WHERE COALESCE(active, TRUE)
      AND (list_contains(COALESCE(trigger_on, ['error']), 'all')
           OR (list_contains(COALESCE(trigger_on, ['error']), 'error') AND error_count > 0)
           OR (list_contains(COALESCE(trigger_on, ['error']), 'warning') AND (error_count > 0 OR warning_count > 0)))"""


@bind("route_alerts", ROUTED_SQL)
def _(t):
    return G.route_alerts(t.validations, hooks(t), "user_id")


@bind(
    "delivery_rollup",
    """
    WITH l AS (SELECT user_id AS webhook_id, ts, CAST(200 + 100 * (attempt % 4) AS INT) AS s FROM deliveries)
    SELECT webhook_id, COUNT(*) AS attempts, COUNT(*) FILTER (WHERE s BETWEEN 200 AND 299) AS delivered,
           COUNT(*) FILTER (WHERE s NOT BETWEEN 200 AND 299) AS failed,
           MAX(ts) FILTER (WHERE s BETWEEN 200 AND 299) AS last_success,
           ROUND(COUNT(*) FILTER (WHERE s NOT BETWEEN 200 AND 299) / COUNT(*), 6) AS failure_share FROM l GROUP BY 1""",
)
def _(t):
    log = t.deliveries.select(
        F.col("user_id").alias("webhook_id"), "ts", F.expr("cast(200 + 100 * (attempt % 4) as int)").alias("http_status")
    )
    return _round(G.delivery_rollup(log), "failure_share")
