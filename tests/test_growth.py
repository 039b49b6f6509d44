"""What grows with the input must not end in the driver or in one task: plans, and results of the changed steps."""

import contextlib

from pyspark.sql import functions as F

from grainguard.bindings import QUERIES
from grainguard.operators import governance as G
from grainguard.operators import rules as R
from tests.oracle import DATA

FOLDER = f"{DATA}/sf0.001"


@contextlib.contextmanager
def fixed_plans(spark):
    """Plans as first made, with all exchanges shown."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def below_last_exchange(lines):
    """The part of a plan that runs where the rows are read."""
    last = max(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    return "\n".join(lines[last + 1 :])


def test_copies_of_keys_are_not_broadcast(spark):
    with fixed_plans(spark):
        requests = spark.createDataFrame([(1, 7), (2, 8)], "event_id int, token long")
        hashed = F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key_hash")
        revoked = F.when(F.col("id") == 8, F.lit("2024-01-01").cast("timestamp_ntz")).alias("revoked_at")
        keys = spark.range(10).select(hashed, F.col("id").alias("user_id"), revoked)
        found = G.attribute_requests(requests, keys)
        assert not any("Broadcast" in line for line in plan(found))
    assert {(r.event_id, r.user_id, r.accepted) for r in found.collect()} == {(1, 7, True), (2, None, False)}


def test_exploded_catalogs_are_not_broadcast(spark):
    with fixed_plans(spark):
        lines = plan(QUERIES["catalog_ingest"](spark, FOLDER))
    assert not any("Broadcast" in line for line in lines)
    assert "Aggregate" not in below_last_exchange(lines)


def test_catalog_rows_are_dealt_out_before_they_are_sorted(spark):
    with fixed_plans(spark):
        for key in ("catalog_fold", "synth_row_budget"):
            read = below_last_exchange(plan(QUERIES[key](spark, FOLDER)))
            assert "Sort" not in read and "Aggregate" not in read


def test_qualification_neither_sorts_nor_deals_the_log_by_column_name(spark):
    with fixed_plans(spark):
        lines = plan(QUERIES["rule_qualification"](spark, FOLDER))
    assert not any("SortAggregate" in line or "SortMergeJoin" in line for line in lines)


def test_qualification_asks_for_another_table(spark):
    rule = R.Rule("q", "q", "required_column_qualification", table="Orders")
    catalog = spark.createDataFrame([("orders", "id")], "table_name string, column_name string")
    rows = [
        (1, "ORDERS", "id", "select", False), (1, "orders", "x", "where", True),  # one table, two spellings
        (2, "orders", "id", "select", False), (2, None, "x", "where", True),
        (3, "orders", "id", "select", False), (3, "parts", "x", "where", True),
        (4, "parts", "id", "select", False), (4, "other", "x", "where", True),
    ]
    refs = spark.createDataFrame(rows, "query_id int, table_name string, column_name string, clause string, qualified boolean")
    assert [r.query_id for r in R.rule_qualification(refs, [rule], catalog).collect()] == [3]
