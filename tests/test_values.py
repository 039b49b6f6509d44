"""Known values on hand-made rows, and invariants between operators."""

import pytest
from pyspark.sql import functions as F

from grainguard.functions.numbers import half_up
from grainguard.operators import conformance as C
from grainguard.operators import governance as G
from grainguard.operators import history as H
from grainguard.operators import joins as J
from grainguard.operators import nulls as N
from grainguard.operators import rules as R
from grainguard.operators import scoring as S
from grainguard.operators import synthesis as Y
from grainguard.operators import windows as W

RUNS = "id long, user_id long, source string, risk_score int, error_count int, warning_count int"


@pytest.fixture
def runs(spark):
    return spark.createDataFrame(
        [
            (1, 1, "manual", 100, 0, 0), (2, 1, "manual", 30, 1, 0), (3, 2, "cursor", 10, 2, 1),
            (4, 2, "cursor", 75, 0, 1), (5, 3, "cursor", 40, 0, 1), (6, 3, None, 90, 0, 0),
        ],
        RUNS,
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_overview_sources_bands(spark, runs):
    assert rows(H.overview(runs)) == [(6, 2, 3, 2)]
    stats = {r["source"]: r for r in H.source_stats(runs).collect()}
    assert list(stats) == ["manual", "cursor", "unknown"]
    assert (stats["manual"]["pass_rate"], stats["cursor"]["pass_rate"], stats["unknown"]["pass_rate"]) == (50, 0, 100)
    assert rows(H.score_distribution(runs)) == [(3, 0, 1, 2)]


def test_top_issues_share_of_runs(spark, runs):
    findings = spark.createDataFrame(
        [(1, 1, "CARTESIAN_JOIN", "error"), (2, 1, "CARTESIAN_JOIN", "warning"), (3, 1, "B", "error"), (4, 1, "A", "suggestion")],
        "query_id long, seq int, issue_id string, severity string",
    )
    assert rows(H.top_issue_types(findings, runs, 5)) == [("CARTESIAN_JOIN", 2, 33), ("B", 1, 17)]


@pytest.mark.parametrize(
    "findings, expected",
    [
        ([], 100), (["suggestion"], 95), (["suggestion"] * 9, 85), (["warning"], 80), (["warning"] * 9, 70),
        (["high"], 60), (["high"] * 2 + ["warning"], 54), (["high"] * 9, 41), (["error"], 25), (["error", "high"], 25),
        (["error"] * 3, 0),
    ],
)
def test_score_policy(spark, findings, expected):
    made = [(1, i, "CROSS_JOIN_RISK" if f == "high" else "X", "warning" if f == "high" else f) for i, f in enumerate(findings)]
    df = spark.createDataFrame(made, "query_id long, seq int, issue_id string, severity string")
    assert S.risk_score(spark.range(1, 2).toDF("query_id"), df).first()["risk_score"] == expected


def test_two_label_scales(spark):
    df = spark.createDataFrame([(40,), (41,), (49,), (50,), (84,), (85,)], "risk_score int")
    assert [r["verdict"] for r in S.verdict(df).collect()] == ["RISKY", "RISKY", "RISKY", "REVIEW", "REVIEW", "SAFE"]
    assert [r["verdict"] for r in S.verdict(df, "panel").collect()] == ["Risky", "Review", "Review", "Review", "Review", "Safe"]


def test_rounding_goes_up_at_half(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (2.4,)], "x double")
    assert [r[0] for r in df.select(half_up(F.col("x"))).collect()] == [-2, 3, 2]


@pytest.mark.parametrize(
    "actual, expected, want",
    [(320, 100, ("inflated", "3.2×")), (10, 100, ("dropping", "10%")), (110, 100, ("ok", "1.10×")), (5, 0, None)],
)
def test_row_count_flag(spark, actual, expected, want):
    got = J.row_count_flag(spark.range(actual).agg(F.count("id").alias("n")), expected).collect()
    assert [(r["row_class"], r["ratio_text"]) for r in got] == ([want] if want else [])


def test_two_children_fan_out(spark):
    parent = spark.range(3).toDF("id")
    a = spark.createDataFrame([(0, 10), (0, 20), (1, 5)], "pid long, amount int")
    b = spark.createDataFrame([(0,), (0,), (0,), (2,)], "pid long")
    proof = J.fanout_proof(a, "amount", "pid", {"b": (b, "pid")}).first()
    assert (int(proof["joined_rows"]), proof["grain_rows"], proof["factor"]) == (6, 2, 3.0)
    kids = J.fanout_children(parent, "id", {"a": (a, "pid"), "b": (b, "pid")}, measure_of="a").first()
    assert (int(kids["crossed_rows"]), kids["multiplied_parents"], kids["offending_child"]) == (6, 1, "b")


def test_not_in_with_and_without_null(spark):
    outer = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for inner, want in (([(1,), (None,)], 0), ([(1,)], 1), ([], 3)):
        df = spark.createDataFrame(inner, "k int")
        got = J.not_in_null_hazard(outer, "k", df, "k").first()
        df.createOrReplaceTempView("inner_keys")
        outer.createOrReplaceTempView("outer_keys")
        by_sql = spark.sql("SELECT count(*) n FROM outer_keys WHERE k NOT IN (SELECT k FROM inner_keys)").first()["n"]
        assert got["not_in_rows"] == want == by_sql


def test_cross_join_is_refused_over_the_limit(spark):
    with pytest.raises(ValueError):
        J.cross_join_bounded(spark.range(100), spark.range(100).toDF("b"), 9_999)


def test_lost_and_kept_rows_add_up(spark):
    left = spark.createDataFrame([(1, 5), (None, 7), (9, 11)], "k int, m int")
    got = J.inner_join_loss(left, "k", spark.createDataFrame([(1,), (1,)], "k int"), "k", "m").first()
    assert got["kept_rows"] + got["null_key_rows"] + got["unmatched_rows"] == got["left_rows"] == 3
    assert (got["null_key_measure"], got["unmatched_measure"]) == (7, 11)


def test_integer_division_of_zero_denominator(spark):
    df = spark.createDataFrame([("a", 7, 2), ("a", 1, 2), ("b", 1, 0)], "g string, n int, d int")
    got = {r["g"]: r for r in N.integer_division_loss(df, "n", "d", ["g"]).collect()}
    assert (got["a"]["truncated"], got["a"]["exact"], got["a"]["rows_lost_to_zero"]) == (2, 2.0, 1)
    assert got["b"]["truncated"] is None and got["b"]["exact"] is None


def test_event_tables_count_as_expensive(spark):
    df = spark.createDataFrame([("aa", 1)], "x string, y int")
    assert all(r["expensive"] for r in N.column_footprint(df, ["x"], "Events").collect())
    assert not any(r["expensive"] for r in N.column_footprint(df, ["x"], "people").collect())


def test_approximate_profile_agrees_on_small_data(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "c")], "x int, y string")
    assert rows(N.column_profile(df).orderBy("column_name")) == rows(N.column_profile(df, True).orderBy("column_name"))


def test_flatten_json_shapes(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": 2}'), (2, "[5, 6]"), (3, None), (4, "broken")], "id int, j string")
    got = sorted(rows(W.flatten_json(df, "j", "int")), key=repr)
    assert got == [(1, "a", 1), (1, "b", 2), (2, "0", 5), (2, "1", 6), (3, None, None), (4, None, None)]


def test_select_aliases_are_not_unresolved(spark):
    catalog = spark.createDataFrame([("t", "a", 1), ("u", "a", 2)], "table_name string, column_name string, ord int")
    refs = spark.createDataFrame(
        [(1, "t", "zz", "order", False), (1, "u", "a", "select", False)],
        "query_id long, table_name string, column_name string, clause string, qualified boolean",
    )
    aliases = spark.createDataFrame([(1, "zz")], "query_id long, alias string")
    assert C.unresolved_columns(refs, catalog).count() == 1
    assert C.unresolved_columns(refs, catalog, aliases).count() == 0
    assert [r["owners"] for r in C.ambiguous_columns(refs, catalog).collect()] == [["t", "u"]]


def test_no_active_rule_finds_nothing(spark):
    refs = spark.createDataFrame([], "query_id long, table_name string, column_name string, clause string, qualified boolean")
    log = spark.createDataFrame([(1, "x")], "query_id long, sql_text string")
    off = [R.Rule("r", "off", "forbidden_pattern", pattern="x", active=False)]
    catalog = spark.createDataFrame([], "table_name string, column_name string")
    assert R.policy_findings(refs, log, off, catalog).count() == 0


def test_unlimited_and_unknown_plans(spark):
    calls = spark.sql("SELECT id, id % 3 AS user_id, timestamp_ntz'2024-01-05 00:00:00' AS created_at FROM range(90)")
    plans = spark.createDataFrame([(0, "free"), (1, "gold")], "user_id long, plan string")
    api = G.quota_gate(calls, plans, {"free": 5}).groupBy("user_id").agg(F.count_if("accepted").alias("n"))
    assert dict(rows(api.select("user_id", "n"))) == {0: 5, 1: 5, 2: 5}
    app = G.quota_gate(calls, plans, {"free": 5}, unknown_as=None).groupBy("user_id").agg(F.count_if("accepted").alias("n"))
    assert dict(rows(app.select("user_id", "n"))) == {0: 5, 1: 30, 2: 30}


def test_generated_tables_repeat_and_keep_constraints(spark):
    specs = [
        Y.ColumnSpec("id", "serial", nullable=False, is_pk=True),
        Y.ColumnSpec("email", "text"),
        Y.ColumnSpec("status", "text", allowed=("on", "off", "idle")),
        Y.ColumnSpec("real_estate", "text"),
        Y.ColumnSpec("country_name", "text"),
    ]
    one = Y.synth_table(Y.row_ids(spark, 2000), "users", specs, seed=7)
    again = Y.synth_table(Y.row_ids(spark, 2000).repartition(5), "users", specs, seed=7)
    assert one.exceptAll(again).isEmpty() and one.count() == 2000
    assert one.where("email NOT RLIKE '^[a-z]+[0-9]{1,3}@[a-z.]+$'").isEmpty()
    assert one.where("real_estate NOT LIKE 'real_estate_%'").isEmpty()
    checks = {r["check"]: r for r in Y.synth_check({"users": one}, {"users": specs}).collect()}
    assert {c["violations"] for c in checks.values()} == {0}
    assert 0.45 < checks["domain"]["first_share"] < 0.55


def test_draws_of_different_columns_are_not_tied(spark):
    specs = [Y.ColumnSpec(n, "int") for n in ("p", "q")]
    df = Y.synth_table(Y.row_ids(spark, 20_000), "t", specs)
    assert abs(df.stat.corr("p", "q")) < 0.03
    assert df.select("p").distinct().count() > 15_000


def test_approximate_profile_is_one_scan(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 10 > 0 THEN id % 7 END AS k", "CAST(NULL AS STRING) AS gone", "string(id % 3) AS s")
    near = N.column_profile(df, approximate=True)
    assert near.dtypes == N.column_profile(df).dtypes
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    exact = {r.column_name: r for r in N.column_profile(df).collect()}
    for r in near.collect():
        e = exact[r.column_name]
        assert (r.rows, r.nulls, r.min_value, r.max_value, r.observed_nullable) == (e.rows, e.nulls, e.min_value, e.max_value, e.observed_nullable)
        assert abs(r.distinct_values - e.distinct_values) <= 0.1 * e.distinct_values
    empty = N.column_profile(df.limit(0), approximate=True).collect()
    assert {(r.rows, r.nulls, r.observed_unique, r.observed_nullable) for r in empty} == {(0, 0, False, False)}
