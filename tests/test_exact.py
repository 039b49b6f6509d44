"""Values that small fixtures hide: NULL keys across chunks, fine scales, ids beyond the modulus, patterns, clean files."""

import decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from grainguard.functions.draws import MODULUS, Draws
from grainguard.operators import joins as J
from grainguard.operators import rules as R
from grainguard.operators import scoring as S
from grainguard.plans.sorted_chunks import carry_last, next_value
from grainguard.sources import history as H


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_null_keys_carry_across_chunks(spark, every_key_hot):
    df = spark.range(4000).selectExpr(
        "IF(id % 3 = 0, NULL, id % 2) AS k", "id AS v", "IF(id % 50 = 0, id, NULL) AS x"
    )
    w = Window.partitionBy("k").orderBy("v")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert rows_of(carry_last(df, ["k"], ["v"], "x", "y")) == rows_of(df.withColumn("y", F.last("x", ignorenulls=True).over(upto)))
    assert rows_of(next_value(df, ["k"], ["v"], "v", "y")) == rows_of(df.withColumn("y", F.lead("v").over(w)))


@pytest.mark.parametrize("type_", ["decimal(18,2)", "decimal(18,4)", "decimal(20,9)", "double", "bigint"])
def test_measures_keep_their_scale(spark, type_):
    value = "0.0040" if type_ != "bigint" else "4"
    fact = spark.range(10).selectExpr("id AS k", f"CAST('{value}' AS {type_}) AS m")
    one = spark.range(10).selectExpr("id AS k")
    dim = spark.range(10).selectExpr("id AS k", "'a' AS g")
    flat = J.inflated_measure(fact, "k", "m", {"o": (one, "k")}, dim, "k", ["g"]).first()
    twice = J.inflated_measure(fact, "k", "m", {"o": (one.union(one), "k")}, dim, "k", ["g"]).first()
    total = decimal.Decimal(str(fact.agg(F.sum("m")).first()[0]))
    same = lambda a, b: abs(decimal.Decimal(str(a)) - b) <= (decimal.Decimal('1e-15') if type_ == 'double' else 0)
    assert same(flat.naive_sum, total) and not flat.is_error and flat.factor in (1.0, None)
    assert same(twice.naive_sum, 2 * total) and twice.is_error == (total != 0)
    joined = J.grain_mismatch(fact, "k", one.union(one), "k", "m").first()
    assert same(joined.joined_sum, 2 * total)


def test_draws_beyond_the_modulus(spark):
    d = Draws(F.col("id"), 7, "t.c")
    ids = spark.range(1000).select((F.col("id") % 500 + F.when(F.col("id") < 500, 0).otherwise(MODULUS)).alias("id"))
    drawn = ids.select("id", d.raw().alias("r"), d.wide(1, 10**15).alias("w")).collect()
    assert len({r.r for r in drawn}) > 990 and len({r.w for r in drawn}) == 1000
    assert max(r.w for r in drawn) > 0.99 * 10**15 and min(r.w for r in drawn) >= 1


def test_patterns_of_the_engine(spark):
    log = spark.createDataFrame([(1, "SELECT a"), (2, "drop (?P<w>x)")], "query_id long, sql_text string")
    fired = lambda p: {r.query_id for r in R.rule_forbidden_pattern(log, [R.Rule("r", "n", "forbidden_pattern", pattern=p)]).collect()}
    assert fired(r"(?<w>select)\s+a") == {1}
    assert fired("(?P<w>x)") == {2}
    assert fired("(") == {2}


def test_clean_files_and_runs(spark):
    log = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "run_id long, query_id long")
    findings = spark.createDataFrame([(1, 1, "X", "error"), (2, 1, "X", "warning")], "query_id long, seq int, issue_id string, severity string")
    assert {tuple(r) for r in S.exit_gate(log, findings, ["run_id"], "query_id").collect()} == {(1, 2, 1, 1), (2, 1, 0, 0)}
    assert {tuple(r) for r in S.exit_gate(log, findings, ["run_id"], "query_id", True).collect()} == {(1, 2, 2, 1), (2, 1, 0, 0)}
    summary = {r.query_id: (r.issues, r.risk_score, r.verdict) for r in H.file_summary(log, findings).collect()}
    assert summary[3] == (0, 100, "SAFE") and len(summary) == 3


def test_draws_of_ids_that_once_agreed(spark):
    """Ids with the same 31-bit mix, ids a multiple of the modulus apart, and many random ones: no whole row repeats."""
    ids = [1000, 2_692_374_532, 1000 + MODULUS, 1000 + 7 * MODULUS, *range(1, 3000), *(i * MODULUS + 1000 for i in range(8, 3000))]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for place in ("t.c", "t.d"):
        d = Draws(F.col("id"), 7, place)
        pairs = df.select(*d.lanes(0)).collect()
        assert len(set(map(tuple, pairs))) == len(set(ids)) and all(0 <= v < MODULUS for p in pairs for v in p)
    values = [r[0] / MODULUS for r in df.select(Draws(F.col("id"), 7, "t.c").raw(0)).collect()]
    assert abs(sum(values) / len(values) - 0.5) < 0.02
    assert max(abs(sum(v < q for v in values) / len(values) - q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)) < 0.03
