"""Readers and writers on real files."""

import pytest
from pyspark.sql import functions as F

from grainguard import session
from grainguard.session import new_folder
from grainguard.sources import catalog as C
from grainguard.sources import history as H


def test_history_is_pruned_by_day_and_column(spark):
    path = new_folder(spark, "history")
    runs = spark.sql(
        """SELECT id, id % 3 AS user_id, 50 AS risk_score, 0 AS error_count, 1 AS warning_count, 'long text' AS report,
                  timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id AS int)) AS created_at FROM range(30)"""
    )
    H.write_history(runs, path)
    scan = H.scan_history(spark, path, "2024-01-10 00:00:00", "2024-01-12 12:00:00")
    assert sorted(r["id"] for r in scan.collect()) == [9, 10, 11]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "report" not in plan.split("ReadSchema")[1]
    assert "PartitionFilters: [isnotnull(created_date" in plan
    assert len(scan.inputFiles()) >= 1


def test_audit_csv_keeps_quotes_breaks_and_empty_cells(spark):
    path = new_folder(spark, "audit")
    runs = spark.createDataFrame(
        [(1, "t1", 'a "b", c', "run\nnext", 7, None), (2, "t2", None, "plain", None, "h")],
        "query_id long, timestamp string, user_email string, event_type string, risk_score int, sql_hash string",
    )
    findings = spark.createDataFrame([(1, "B"), (1, "A"), (1, "B")], "query_id long, issue_id string")
    H.audit_csv(H.audit_rows(runs, findings), path)
    got = sorted(map(tuple, H.read_audit_csv(spark, path).collect()))
    assert got == [("t1", 'a "b", c', "run\nnext", "7", "A|B", ""), ("t2", "", "plain", "", "", "h")]


def test_catalog_fold_takes_first_type_and_last_target(spark):
    rows = spark.createDataFrame(
        [
            (1, "t", "c", "INTEGER ", "yes", "PRIMARY KEY", None, None),
            (2, "t", "c", "text", "NO", "FOREIGN KEY", "a", "x"),
            (3, "t", "c", "text", "NO", "FOREIGN KEY", "b", None),
            (4, "t", None, "text", "NO", None, None, None),
            (5, "t", "d", "Money", "NO", None, None, None),
        ],
        "ord int, table_name string, column_name string, data_type string, is_nullable string, constraint_type string, "
        "foreign_table_name string, foreign_column_name string",
    )
    got = {r["column_name"]: r for r in C.catalog_fold(rows).collect()}
    assert set(got) == {"c", "d"}
    c = got["c"]
    assert (c["type"], c["nullable"], c["is_pk"], c["is_fk"], c["fk_table"], c["fk_column"]) == ("int", True, True, True, "b", "x")
    assert got["d"]["type"] == "money"


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_cut_survives_in_the_shared_folder(spark):
    df = session.cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert spark.sparkContext.getCheckpointDir() is not None
