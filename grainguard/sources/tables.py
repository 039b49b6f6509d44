"""Explicit schemas of the given tables and the views derived from them.

Reading with a declared schema saves the footer-reading inference job. The view
texts run unchanged in Spark SQL and in the oracle database, so both sides see
the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainguard.plans.sorted_chunks import next_value

# Column types of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# The last order date; every "as of" in the bindings uses it instead of now().
AS_OF = "2001-08-01 00:00:00"

VIEWS = {
    "orders_n": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    WHEN o_orderkey % 11 = 0 THEN -o_custkey - 1
                    ELSE o_custkey END AS o_custkey,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL
                    ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
               CAST(o_orderkey % 13 AS INT) AS done, CAST(13 AS INT) AS planned,
               o_orderstatus, o_orderdate
        FROM orders""",
    "findings": """
        SELECT l_orderkey AS query_id, l_linenumber AS seq,
               CASE CAST(l_partkey % 10 AS INT)
                 WHEN 0 THEN 'AGGREGATE_OVER_FANOUT_JOIN' WHEN 1 THEN 'HALLUCINATED_COLUMN'
                 WHEN 2 THEN 'LEFT_JOIN_FILTERED_IN_WHERE' WHEN 3 THEN 'MISSING_TIME_FILTER'
                 WHEN 4 THEN 'JOIN_MULTIPLICATION' WHEN 5 THEN 'COUNT_PARENT_AFTER_CHILD_JOIN'
                 WHEN 6 THEN 'AVG_OVER_NULLABLE' WHEN 7 THEN 'IMPLICIT_TIMEZONE'
                 WHEN 8 THEN 'SELECT_STAR_EXPENSIVE' ELSE 'DESTRUCTIVE_TRUNCATE' END AS issue_id,
               CASE WHEN CAST(l_partkey % 10 AS INT) IN (0, 1, 9) THEN 'error'
                    WHEN CAST(l_partkey % 10 AS INT) IN (2, 3, 4, 5) THEN 'warning'
                    ELSE 'suggestion' END AS severity
        FROM lineitem""",
    "validations": """
        SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_custkey % 20 AS INT) AS team_id,
               CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'manual' WHEN 1 THEN 'cursor' WHEN 2 THEN 'copilot'
                    WHEN 3 THEN 'chatgpt' WHEN 4 THEN 'inhouse' ELSE NULL END AS source,
               CAST((o_orderkey * 37) % 101 AS INT) AS risk_score,
               CAST(CASE WHEN (o_orderkey * 37) % 101 <= 40 THEN 1 + o_orderkey % 3 ELSE 0 END AS INT) AS error_count,
               CAST(CASE WHEN (o_orderkey * 37) % 101 BETWEEN 30 AND 84 THEN 1 + o_orderkey % 2 ELSE 0 END AS INT)
                 AS warning_count,
               o_orderdate AS created_at
        FROM orders""",
    "refs": """
        SELECT l_orderkey AS query_id,
               CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'orders' WHEN 1 THEN 'customer' WHEN 2 THEN 'custmer'
                    WHEN 3 THEN 'events' ELSE 'warehouse_zones' END AS table_name,
               CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'o_orderkey' WHEN 1 THEN 'o_totl_price'
                    WHEN 2 THEN 'c_custkey' WHEN 3 THEN 'value' WHEN 4 THEN 'ts' ELSE 'status' END AS column_name,
               CASE WHEN l_linenumber % 2 = 0 THEN 'where' WHEN l_linenumber % 3 = 0 THEN 'on'
                    ELSE 'select' END AS clause,
               l_linenumber % 4 <> 0 AS qualified
        FROM lineitem""",
    "scope": """
        SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus <> 'P' THEN 'orders' END AS alias
        FROM orders
        UNION ALL
        SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN 'customer' END AS alias
        FROM orders""",
    "query_log": """
        SELECT o_orderkey AS query_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'postgresql' ELSE 'snowflake' END AS dialect,
               CASE CAST(o_orderkey % 5 AS INT)
                 WHEN 0 THEN 'SELECT * FROM orders LIMIT 10, 5'
                 WHEN 1 THEN 'SELECT TOP 20 o_orderkey FROM orders'
                 WHEN 2 THEN 'SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) = 1'
                 WHEN 3 THEN 'SELECT DATE_SUB(o_orderdate, 3) FROM orders'
                 ELSE 'SELECT o_orderkey FROM orders WHERE o_custkey = 7' END AS sql_text
        FROM orders""",
    "deliveries": """
        SELECT event_id % 1000 AS delivery_key, event_id AS attempt, ts, user_id,
               CASE event_type WHEN 'signup' THEN 'subscription.created' WHEN 'purchase' THEN 'payment.succeeded'
                    WHEN 'error' THEN 'payment.failed' WHEN 'click' THEN 'subscription.updated'
                    ELSE 'subscription.deleted' END AS kind,
               event_id % 4 <> 0 AS completed
        FROM events""",
}

# Catalog export of one database: ord, table, column, type, nullable, constraint, FK table, FK column.
CATALOG_ROWS = [
    (1, "orders", "o_orderkey", "bigint", "NO", "PRIMARY KEY", None, None),
    (2, "orders", "o_custkey", "bigint", "YES", "FOREIGN KEY", "customer", "c_custkey"),
    (3, "orders", "o_totalprice", "double precision", "YES", None, None, None),
    (4, "orders", "status", "character varying", "YES", None, None, None),
    (5, "customer", "c_custkey", "bigint", "NO", "PRIMARY KEY", None, None),
    (6, "customer", "status", "character varying", "YES", None, None, None),
    (7, "events", "event_id", "bigint", "NO", "PRIMARY KEY", None, None),
    (8, "events", "user_id", "bigint", "NO", "UNIQUE", None, None),
    (9, "events", "user_id", "bigint", "NO", "FOREIGN KEY", "customer", "c_custkey"),
    (10, "events", "ts", "timestamp without time zone", "NO", None, None, None),
    (11, "events", "value", "double precision", "YES", None, None, None),
    (12, "", "ghost", "text", "YES", None, None, None),
]
CATALOG_SCHEMA = (
    "ord int, table_name string, column_name string, data_type string, is_nullable string, "
    "constraint_type string, foreign_table_name string, foreign_column_name string"
)


def _literal(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


_VALUES = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in CATALOG_ROWS)
_CATALOG_NAMES = ", ".join(c.split()[0] for c in CATALOG_SCHEMA.split(", "))

# Oracle-only texts; Spark builds these views with DataFrame code in Tables, for scale.
ORACLE_VIEWS = {
    "customer_history": """
        SELECT o_custkey AS cust, o_orderpriority AS tier, o_orderdate AS valid_from,
               lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to
        FROM orders""",
    "catalog_rows": f"SELECT * FROM (VALUES {_VALUES}) AS t({_CATALOG_NAMES})",
    # One exported catalog per customer database: the shape of a shared catalog service.
    "catalog_log": f"""
        SELECT c_custkey AS database_id, t.*
        FROM customer, (VALUES {_VALUES}) AS t({_CATALOG_NAMES})""",
}


def with_views(sql: str) -> str:
    """Prefix an oracle text with the derived views it mentions."""
    views = {**VIEWS, **ORACLE_VIEWS}
    used = [v for v in views if re.search(rf"\b{v}\b", sql)]
    sql = sql.strip()
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS ({views[v].strip()})" for v in used)
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE)
    if own:
        return f"WITH {own.group(1) or ''}{ctes}, {sql[own.end():]}"
    return f"WITH {ctes} {sql}"


class Tables:
    """Given tables and derived views of one data folder as DataFrames, by attribute name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in SCHEMAS:
                df = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                # Each FROM of a view starts a line, so names inside its text literals are left alone.
                used = set(re.findall(r"(?m)^ *FROM (\w+)", VIEWS[name]))
                text = re.sub(r"(?m)^( *FROM )(\w+)", r"\1{\2}", VIEWS[name])
                df = self.spark.sql(text, **{t: getattr(self, t) for t in used})
            else:
                raise AttributeError(name)
            self._seen[name] = df
        return self._seen[name]

    @cached_property
    def customer_history(self) -> DataFrame:
        versions = self.orders.select(
            F.col("o_custkey").alias("cust"),
            F.col("o_orderpriority").alias("tier"),
            F.col("o_orderdate").alias("valid_from"),
            "o_orderkey",
        )
        return next_value(versions, ["cust"], ["valid_from", "o_orderkey"], "valid_from", "valid_to").drop("o_orderkey")

    @cached_property
    def catalog_rows(self) -> DataFrame:
        return self.spark.createDataFrame(CATALOG_ROWS, CATALOG_SCHEMA)

    @cached_property
    def catalog_log(self) -> DataFrame:
        rows = [F.struct(*[F.lit(v).alias(c.split()[0]) if v is not None else F.lit(None).cast(c.split()[1]).alias(c.split()[0])
                for v, c in zip(r, CATALOG_SCHEMA.split(", "))]) for r in CATALOG_ROWS]
        return self.customer.select(F.col("c_custkey").alias("database_id"), F.inline(F.array(*rows)))
