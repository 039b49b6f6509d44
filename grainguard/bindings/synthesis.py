"""Generated twins of the given tables: as many rows, all values synthetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainguard.bindings.joins import _big, _round
from grainguard.bindings.registry import bind
from grainguard.functions import pools as P
from grainguard.functions.draws import MODULUS, SECOND_STEP, STEP, salt
from grainguard.operators import synthesis as S
from grainguard.sources.catalog import catalog_fold

SEED = 11


def _specs(*lines):
    out = []
    for line in lines:
        name, type_, *rest = line
        out.append(S.ColumnSpec(name, type_, **(rest[0] if rest else {})))
    return out


PERSON = _specs(
    ("id", "bigint", {"is_pk": True, "nullable": False}),
    ("email", "varchar"), ("country_code", "char"), ("country", "varchar"), ("state_code", "char"), ("home_state", "varchar"),
    ("first_name", "varchar"), ("last_name", "varchar"), ("user_name", "varchar"), ("company_name", "varchar"),
    ("full_name", "varchar"), ("city", "varchar"), ("street", "varchar"), ("zip", "varchar"), ("employer", "text"),
    ("phone", "varchar"), ("order_status", "varchar"), ("created_at", "timestamp"), ("amount", "numeric"),
    ("quantity", "int"), ("tier", "text", {"allowed": ("gold", "silver", "bronze")}), ("is_open", "boolean"),
    ("ref", "uuid"), ("points", "int"), ("weight", "double"), ("note", "text"),
    ("customer_id", "bigint", {"is_fk": True, "fk_table": "customer", "fk_column": "id"}),
)


class Sql:
    """The generator's arithmetic as SQL text over a column ``id``."""

    def __init__(self, table, column, seed=SEED):
        self.place, self.seed = f"{table}.{column}" if table else column, seed

    def lanes(self, draw=0):
        low, high = f"(id % {MODULUS})", f"(id // {MODULUS} % {MODULUS})"
        first, second = salt(self.seed, self.place, draw), salt(self.seed, f"{self.place}/", draw)
        a = f"(({low} * {STEP} + {high} * {SECOND_STEP} + {first}) % {MODULUS})"
        b = f"(({low} * {SECOND_STEP} + {high} * {STEP} + {second}) % {MODULUS})"
        x = f"(({b} + {a} * ({a} + {SECOND_STEP}) % {MODULUS}) % {MODULUS})"
        return x, f"(({a} + {x} * ({x} + {STEP}) % {MODULUS}) % {MODULUS})"

    def raw(self, draw=0):
        return self.lanes(draw)[1]

    def int(self, low, high, draw=0):
        return f"({self.raw(draw)} % {high - low + 1} + {low})"

    def wide(self, draw=0):
        x, y = self.lanes(draw)
        return f"({x} * {MODULUS} + {y})"

    def unit(self, draw=0):
        return f"((CAST({self.raw(draw)} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({MODULUS} AS DOUBLE))"

    def pick(self, words, draw=0):
        return f"[{', '.join(repr(w) for w in words)}][CAST({self.raw(draw)} % {len(words)} + 1 AS INT)]"


def _twin_sql(table):
    c = {s.name: Sql(table, s.name) for s in PERSON}
    two = "FLOOR({} * 100 + CAST(0.5 AS DOUBLE)) / 100"
    normal = f"250 + sqrt(-2 * ln({c['amount'].unit(0)})) * cos(2 * pi() * {c['amount'].unit(1)}) * 120"
    h = f"md5('{SEED}/{table}.ref/' || id)"
    values = {
        "email": f"lower({c['email'].pick(P.FIRST_NAMES)}) || {c['email'].int(1, 999, 1)} || '@' || {c['email'].pick(P.DOMAINS, 2)}",
        "country_code": c["country_code"].pick(P.COUNTRY_CODES),
        "country": c["country"].pick(P.COUNTRIES),
        "state_code": c["state_code"].pick(P.STATE_CODES),
        "home_state": c["home_state"].pick(P.STATES),
        "first_name": c["first_name"].pick(P.FIRST_NAMES),
        "last_name": c["last_name"].pick(P.LAST_NAMES),
        "user_name": f"lower({c['user_name'].pick(P.FIRST_NAMES)}) || {c['user_name'].int(1, 99, 1)}",
        "company_name": f"{c['company_name'].pick(P.LAST_NAMES)} || ' ' || {c['company_name'].pick(P.COMPANY_SUFFIXES, 1)}",
        "full_name": f"{c['full_name'].pick(P.FIRST_NAMES)} || ' ' || {c['full_name'].pick(P.LAST_NAMES, 1)}",
        "city": c["city"].pick(P.CITIES),
        "street": f"{c['street'].int(1, 9999)} || ' ' || {c['street'].pick(P.STREET_NAMES, 1)} || ' ' || {c['street'].pick(P.STREET_TYPES, 2)}",
        "zip": f"CAST({c['zip'].int(10000, 99999)} AS VARCHAR)",
        "employer": f"{c['employer'].pick(P.LAST_NAMES)} || ' ' || {c['employer'].pick(P.COMPANY_SUFFIXES, 1)}",
        "phone": f"'+1' || {c['phone'].int(20000, 99999)} || lpad(CAST({c['phone'].int(0, 99999, 1)} AS VARCHAR), 5, '0')",
        "order_status": c["order_status"].pick(P.STATUSES),
        "created_at": f"TIMESTAMP '2026-06-01 00:00:00' - to_days(CAST({c['created_at'].int(0, 365)} AS INT))",
        "amount": two.format(f"GREATEST(CAST(0 AS DOUBLE), {normal})"),
        "quantity": c["quantity"].int(1, 100),
        "tier": f"CASE WHEN {c['tier'].unit()} < 0.5 THEN 'gold' ELSE {c['tier'].pick(('silver', 'bronze'), 1)} END",
        "is_open": f"{c['is_open'].int(0, 1)} = 1",
        "ref": f"{h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32]",
        "points": c["points"].int(1, 100_000),
        "weight": two.format(f"(1 + {c['weight'].unit()} * 9999)"),
        "note": f"'note_' || {c['note'].int(1, 9999)}",
        "customer_id": f"{c['customer_id'].wide()} % (SELECT COUNT(*) FROM customer) + 1",
    }
    return ", ".join(["id", *[f"{v} AS {k}" for k, v in values.items()]])


@bind("synth_table", f"WITH i AS (SELECT o_orderkey + 1 AS id FROM orders) SELECT {_twin_sql('orders')} FROM i")
def _(t):
    ids = t.orders.select((F.col("o_orderkey") + 1).alias("id"))
    return S.synth_table(ids, "orders", PERSON, SEED, {"customer": t.customer.count()})


@bind(
    "synth_fk",
    f"""
    WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer),
         i AS (SELECT o_orderkey + 1 AS id FROM orders),
         d AS (SELECT id, {Sql('', 'owner').wide()} % (SELECT COUNT(*) FROM customer) + 1 AS rn FROM i)
    SELECT id, c_custkey AS owner FROM d JOIN p ON p.rn = d.rn""",
)
def _(t):
    ids = t.orders.select((F.col("o_orderkey") + 1).alias("id"))
    return S.synth_fk(ids, t.customer, "c_custkey", "owner", SEED)


@bind(
    "synth_row_budget",
    """
    WITH f AS (SELECT database_id, table_name, COUNT(DISTINCT column_name) FILTER (WHERE constraint_type = 'FOREIGN KEY') AS foreign_keys
               FROM catalog_log WHERE table_name <> '' GROUP BY 1, 2)
    SELECT *, CAST(50 * pow(3, LEAST(foreign_keys, 3)) AS BIGINT) AS "rows" FROM f""",
)
def _(t):
    return S.synth_row_budget(catalog_fold(t.catalog_log, ["database_id"]), ["database_id"])


PROOF_SPECS = {
    "customer": _specs(("id", "bigint", {"is_pk": True, "nullable": False}), ("tier", "text", {"allowed": ("gold", "silver", "bronze")})),
    "orders": _specs(
        ("id", "bigint", {"is_pk": True, "nullable": False}),
        ("customer_id", "bigint", {"is_fk": True, "fk_table": "customer", "fk_column": "id"}),
        ("total", "numeric"),
    ),
    "events": _specs(
        ("id", "bigint", {"is_pk": True, "nullable": False}),
        ("customer_id", "bigint", {"is_fk": True, "fk_table": "customer", "fk_column": "id"}),
    ),
}


def _ids(t):
    return {
        "customer": t.customer.select((F.col("c_custkey") + 1).alias("id")),
        "orders": t.orders.select((F.col("o_orderkey") + 1).alias("id")),
        "events": t.events.select((F.col("event_id") + 1).alias("id")),
    }


def _fk_sql(table, source, key, seed):
    draw = Sql(table, "customer_id", seed).wide()
    return f"""SELECT id, {draw} % (SELECT COUNT(*) FROM customer) + 1 AS customer_id FROM (SELECT {key} + 1 AS id FROM {source})"""


@bind(
    "synth_check",
    f"""
    WITH c AS (SELECT CASE WHEN {Sql('customer', 'tier').unit()} < 0.5 THEN 1 ELSE 0 END AS first FROM (SELECT c_custkey + 1 AS id FROM customer))
    SELECT table_name, column_name, "check", CAST(0 AS BIGINT) AS violations,
           CASE WHEN "check" = 'domain' THEN (SELECT ROUND(AVG(first), 6) FROM c) END AS first_share
    FROM (VALUES ('customer', 'id', 'unique'), ('customer', 'id', 'not_null'), ('customer', 'tier', 'domain'),
                 ('orders', 'id', 'unique'), ('orders', 'id', 'not_null'), ('orders', 'customer_id', 'foreign_key'),
                 ('events', 'id', 'unique'), ('events', 'id', 'not_null'), ('events', 'customer_id', 'foreign_key'))
         AS t(table_name, column_name, "check")""",
)
def _(t):
    sizes = {"customer": t.customer.count()}
    made = {name: S.synth_table(ids, name, PROOF_SPECS[name], SEED, sizes) for name, ids in _ids(t).items()}
    return _round(S.synth_check(made, PROOF_SPECS), "first_share")


@bind(
    "proof_on_synthetic",
    f"""
    WITH o AS ({_fk_sql('orders', 'orders', 'o_orderkey', 7)}), e AS ({_fk_sql('events', 'events', 'event_id', 7)})
    SELECT COUNT(*) AS joined_rows, COUNT(DISTINCT o.customer_id) AS grain_rows,
           ROUND(COUNT(*) / GREATEST(1, COUNT(DISTINCT o.customer_id)), 6) AS factor
    FROM o JOIN e ON e.customer_id = o.customer_id""",
)
def _(t):
    df = S.proof_on_synthetic(
        _ids(t), {"customer": t.customer.count()}, PROOF_SPECS, "customer",
        {"orders": "customer_id", "events": "customer_id"}, "id",
    )
    return _round(_big(df, "joined_rows"), "factor")
