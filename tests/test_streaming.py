"""Several unsorted files, one per micro-batch, and a restart in between: streams end at the batch result."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from grainguard.operators.claims import claim_events
from grainguard.session import new_folder
from grainguard.streaming import files, jobs
from grainguard.streaming.claims import outcomes_of, stream_claims

ATTEMPTS = "key long, ts timestamp_ntz, attempt long, completed boolean, failed boolean"
RUNS = "user_id long, created_at timestamp_ntz, error_count int, risk_score int"
FINDINGS = "query_id long, seq int, issue_id string, severity string"


def shuffled_files(spark, rows, schema, folder, parts=5, seed=1):
    """Rows in random order over several files; days to years apart within and between them."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, schema)


def parts_of(spark, folder, schema, reduce):
    stream = files.read_files(spark, schema, folder, "*.parquet", files_per_trigger=1)
    path = files.run_available(stream, new_folder(spark, "out"), "append", lambda batch, _: reduce(batch))
    parts = spark.read.option("basePath", path).parquet(path)
    assert parts.select(files.BATCH).distinct().count() >= 4
    return parts.drop(files.BATCH)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def runs():
    start = datetime.datetime(2024, 1, 1)
    return [(i % 7 if i % 11 else None, start + datetime.timedelta(hours=13 * i), i % 3 and i % 2, i * 37 % 101) for i in range(600)]


def test_usage_digest_and_sliding_digest(spark):
    folder = new_folder(spark, "in")
    df = shuffled_files(spark, runs(), RUNS, folder)
    got = jobs.usage_by_month(parts_of(spark, folder, RUNS, jobs.stream_usage))
    assert rows_of(got) == rows_of(jobs.usage_by_month(jobs.stream_usage(df)))
    assert got.agg(F.sum("runs")).first()[0] == 600
    for window in (("7 days", None), ("30 days", "10 days")):
        got = jobs.digest_of(parts_of(spark, folder, RUNS, lambda b, w=window: jobs.stream_digest(b, *w)))
        assert rows_of(got) == rows_of(jobs.digest_of(jobs.stream_digest(df, *window)))
        assert got.agg(F.sum("runs")).first()[0] == 600 * (3 if window[1] else 1)


def test_dedup_and_risk(spark):
    folder = new_folder(spark, "in")
    rows = [(i % 40, i, "X", ("error", "warning", "suggestion", "suggestion")[i % 4]) for i in range(300)]
    df = shuffled_files(spark, rows, FINDINGS, folder)
    got = jobs.risk_of(parts_of(spark, folder, FINDINGS, jobs.stream_risk))
    assert rows_of(got) == rows_of(jobs.risk_of(jobs.stream_risk(df)))
    keys = jobs.keys_of(parts_of(spark, folder, FINDINGS, lambda b: jobs.stream_dedup(b, "query_id")))
    assert rows_of(keys) == [(i,) for i in sorted(range(40), key=lambda i: repr((i,)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_in_any_order_with_a_restart(spark, seed):
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (i % 5, start + datetime.timedelta(seconds=37 * i, days=9 * (i // 100)), i, i % 17 == 0 and i % 5 > 0, i % 23 == 0)
        for i in range(400)
    ]
    folder, out = new_folder(spark, "in"), new_folder(spark, "out")

    def run():
        stream = files.read_files(spark, ATTEMPTS, folder, "*.parquet", files_per_trigger=1)
        return stream_claims(stream, out, "key", "ts", "attempt", "completed", "failed")

    shuffled_files(spark, rows[::2], ATTEMPTS, folder, parts=2, seed=seed)
    run()
    shuffled_files(spark, rows[1::2], ATTEMPTS, folder, parts=2, seed=seed)
    path = run()
    got = outcomes_of(spark, path, "key", "attempt").select("key", "attempt", "outcome")
    want = claim_events(spark.createDataFrame(rows, ATTEMPTS), "key", "ts", "attempt", "completed", "failed")
    assert rows_of(got) == rows_of(want) and got.count() == 400


def test_batches_are_overwritten_not_repeated(spark):
    path = new_folder(spark, "out")
    for _ in range(2):
        spark.range(5).toDF("x").write.mode("overwrite").parquet(f"{path}/batch_id=0")
    assert files.all_batches(spark, path).agg(F.count("x")).first()[0] == 5
