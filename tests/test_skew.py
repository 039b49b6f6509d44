"""One key holds a third of all rows and more: results stay exact and whole."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from grainguard.functions.names import nearest_name
from grainguard.operators import joins as J
from grainguard.operators.claims import DONE, FREE, claim_events, fold, gate_after
from grainguard.plans.shapes import array_shards
from grainguard.plans.sorted_chunks import carry_last, exact_ranks, next_value, sorted_chunks
from grainguard.sources.history import report_explode, report_nest


def skewed(spark, n=4000, values=7):
    """Key 0 owns half of the rows; few order values, so runs of ties cross chunk borders."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 11).cast("int").alias("k"),
        (F.xxhash64("id") % values).alias("v"),
    )


@pytest.mark.parametrize("values", [1, 3, 50, 100_000])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_across_chunks(spark, every_key_hot, values, descending):
    df = skewed(spark, values=values)
    got = exact_ranks(df, ["k"], "v", "id", descending)
    order = F.desc("v") if descending else F.asc("v")
    w = Window.partitionBy("k").orderBy(order)
    want = df.select(
        "id", "k", "v",
        F.row_number().over(Window.partitionBy("k").orderBy(order, "id")).cast("bigint").alias("row_number"),
        F.rank().over(w).cast("bigint").alias("rank"),
        F.dense_rank().over(w).cast("bigint").alias("dense_rank"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ranks_with_null_partition_and_null_order(spark, every_key_hot):
    df = skewed(spark, 600, 5).withColumns(
        {"k": F.when(F.col("k") == 0, None).otherwise(F.col("k")), "v": F.when(F.col("v") == 0, None).otherwise(F.col("v"))}
    )
    got = exact_ranks(df, ["k"], "v", "id", kinds=["row_number"])
    want = df.withColumn("row_number", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")).cast("bigint"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_hot_key_is_spread_over_chunks(spark, many_chunks):
    chunks = sorted_chunks(skewed(spark, 8000), ["k"], ["v", "id"])
    assert chunks.where("k = 0").select("_chunk").distinct().count() >= 3


def test_carry_last_across_chunks(spark, every_key_hot):
    df = skewed(spark).withColumn("x", F.when(F.pmod(F.xxhash64("id"), F.lit(40)) == 0, F.col("id")))
    got = carry_last(df, ["k"], ["v", "id"], "x", "last_x")
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("last_x", F.last("x", ignorenulls=True).over(w))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_next_value_across_chunks(spark, every_key_hot):
    df = skewed(spark).withColumn("x", F.when(F.pmod(F.xxhash64("id"), F.lit(3)) > 0, F.col("id")))
    got = next_value(df, ["k"], ["v", "id"], "x", "next_x")
    want = df.withColumn("next_x", F.lead("x").over(Window.partitionBy("k").orderBy("v", "id")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def by_hand(attempts, stale):
    gates, out = {}, {}
    for key, t, attempt, done, failed in sorted(attempts, key=lambda a: (a[0], a[1], a[2])):
        gate = gates.get(key, FREE)
        if gate == DONE:
            out[attempt] = "duplicate"
        elif t < gate:
            out[attempt] = "in_flight"
        else:
            out[attempt] = "processed" if gate == FREE else "reclaimed"
            gates[key] = gate_after(t, done, failed, stale)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_claims_of_a_hot_key(spark, many_chunks, seed):
    """Half of all attempts share one key that never completes for long, so its chain crosses many chunks."""
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for attempt in range(3000):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 60)
        micros = rng.randrange(0, 40_000_000_000)
        done = rng.random() < (0.001 if key == 0 else 0.3)
        failed = not done and rng.random() < 0.1
        rows.append((key, micros, attempt, done, failed))
    df = spark.createDataFrame(
        [(k, start + datetime.timedelta(microseconds=m), a, d, f) for k, m, a, d, f in rows],
        "key long, ts timestamp_ntz, attempt long, completed boolean, failed boolean",
    ).repartition(8)
    base = int((start - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    want = by_hand([(k, base + m, a, d, f) for k, m, a, d, f in rows], 300_000_000)
    got = {r["attempt"]: r["outcome"] for r in claim_events(df, "key", "ts", "attempt", "completed", "failed").collect()}
    assert got == want
    assert len(set(got.values())) == 4


def test_gates():
    assert gate_after(10, True, False, 5) == DONE
    assert gate_after(10, False, True, 5) == FREE
    no, yes = [False] * 4, [True] * 4
    assert fold([1, 5, 6, 20], no, no, FREE, 5) == (["processed", "in_flight", "reclaimed", "reclaimed"], 25)
    assert fold([1, 5, 6, 20], yes, no, 6, 5) == (["in_flight", "in_flight", "reclaimed", "duplicate"], DONE)
    assert fold([1, 2], no, yes, FREE, 5) == (["processed", "processed"], FREE)


def test_large_report_is_paged_and_comes_back_whole(spark):
    findings = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("query_id"),
        (F.col("id") % 500).cast("int").alias("seq"),
        F.concat(F.lit("I"), (F.col("id") % 7).cast("string")).alias("issue_id"),
        F.when(F.col("id") % 2 == 0, "error").otherwise("suggestion").alias("severity"),
    )
    reports = report_nest(findings, page_size=100)
    assert reports.where("query_id = 1").count() > 5
    assert reports.where("query_id = 1 AND execution_safe").count() == 0
    back = report_explode(reports).select(findings.columns)
    assert back.exceptAll(findings).isEmpty() and findings.exceptAll(back).isEmpty()


def test_array_shards_split_a_hot_group(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), "id")
    shards = array_shards(df, ["g"], F.col("id"), "ids", size=100)
    sizes = [r["n"] for r in shards.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 5000 and max(sizes) < 300


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_nearest_name_equals_trying_every_pair(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdE_") for _ in range(rng.randrange(1, 19)))
    names, candidates = {word() for _ in range(150)}, list(dict.fromkeys(word() for _ in range(120)))
    got = nearest_name(
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame(list(enumerate(candidates)), "ord int, candidate string"),
        "name", "candidate", "ord",
    )
    found = {r["name"]: r["nearest"] for r in got.collect()}
    for n in names:
        d, i = min((distance(n.lower(), c.lower()), i) for i, c in enumerate(candidates))
        best = candidates[i]
        limit = max(3, -(-4 * max(len(n), len(best)) // 10))
        assert found.get(n) == (best if d <= limit else None), n


def test_counts_do_not_overflow(spark):
    """Two hot keys of 4e9 rows each, given as counts, multiply to more than a BIGINT holds."""
    from grainguard.plans.shapes import times

    one = spark.sql("SELECT 4000000000L AS a, 4000000000L AS b").select(times("a", "b").alias("n")).first()
    assert int(one["n"]) == 16 * 10**18


def test_effective_date_join_equals_range_join_on_a_hot_key(spark, every_key_hot):
    history = spark.range(400).select(
        F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("k"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id)").alias("a"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id + id % 2)").alias("b"),
        F.col("id").alias("version"),
    )
    fact = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 400).alias("fk"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 10.5)").alias("t"),
        "id",
    )
    got = J.effective_date_join(fact, "fk", "t", history, "k", "a", "b", ["version"]).select("id", "version")
    want = fact.join(history, F.expr("fk = k AND a <= t AND t < b")).select("id", "version")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 0
