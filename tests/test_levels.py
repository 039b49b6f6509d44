"""Levelled parts of streams: many batches, killed merges, repeated batches; claim state that reads what a batch needs."""

import math
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from grainguard.operators.claims import DONE, FREE, claim_events, fold
from grainguard.session import new_folder
from grainguard.streaming import files, jobs, levels
from grainguard.streaming.claims import ClaimHistory, outcomes_of, stream_claims

RUNS = "user_id long, created_at timestamp_ntz, error_count int, risk_score int"


def total(parts):
    return jobs.added_up(parts, ["k"])


def batch(spark, i):
    return spark.createDataFrame([(i % 3, 1), (None, i)], "k long, n long")


def sums(spark, out):
    return sorted(map(tuple, total(levels.read_parts(spark, out)).collect()), key=repr)


def want(n):
    return sorted([(k, sum(i % 3 == k for i in range(n))) for k in range(min(n, 3))] + [(None, sum(range(n)))], key=repr)


def test_parts_grow_with_the_logarithm(spark):
    out, most = new_folder(spark, "parts"), 0
    for i in range(40):
        levels.commit(spark, out, i, batch(spark, i), total, fanout=3)
        most = max(most, len(levels.manifest(spark, out)["parts"]))
    assert most <= 2 * math.ceil(math.log(41, 3)) and sums(spark, out) == want(40)
    read = levels.read_parts(spark, out)
    assert len(read.inputFiles()) < 40 and read.count() < 40
    live = {p["folder"] for p in levels.manifest(spark, out)["parts"]}
    gone = levels.vacuum(spark, out)
    assert gone and not {f"parts/{p}" for p in live} & set(gone)
    assert sums(spark, out) == want(40) and levels.vacuum(spark, out) == []


@pytest.mark.parametrize("dies", ["while folding", "before the manifest"])
def test_a_killed_merge_loses_nothing(spark, monkeypatch, dies):
    out = new_folder(spark, "parts")
    for i in range(3):
        levels.commit(spark, out, i, batch(spark, i), total, fanout=4)
    before = levels.manifest(spark, out)
    publish = levels.publish

    def broken(*_):
        raise RuntimeError("killed")

    def dying(spark, out, now, batch_id, parts):
        if any(p["level"] == 1 for p in parts):
            raise RuntimeError("killed")
        return publish(spark, out, now, batch_id, parts)

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        if dies == "before the manifest":
            patch.setattr(levels, "publish", dying)
        levels.commit(spark, out, 3, batch(spark, 3), broken if dies == "while folding" else total, fanout=4)
    # The batch itself is in, the merge is not; a repetition of the batch makes up for it and adds nothing.
    assert len(levels.manifest(spark, out)["parts"]) == len(before["parts"]) + 1 and sums(spark, out) == want(4)
    levels.commit(spark, out, 3, batch(spark, 3), total, fanout=4)
    assert [p["level"] for p in levels.manifest(spark, out)["parts"]] == [1] and sums(spark, out) == want(4)


def test_a_second_writer_is_refused(spark):
    out = new_folder(spark, "parts")
    stale = levels.manifest(spark, out)
    levels.commit(spark, out, 0, batch(spark, 0), total)
    with pytest.raises(Exception, match="exists"):
        levels.publish(spark, out, stale, 0, [])
    assert sums(spark, out) == want(1)


def test_no_batch_yet(spark):
    with pytest.raises(ValueError):
        levels.read_parts(spark, new_folder(spark, "parts"))


def test_a_stream_killed_in_a_merge(spark):
    folder, out = new_folder(spark, "in"), new_folder(spark, "out")
    rows = [(i % 7 if i % 11 else None, None if i % 13 == 0 else f"2024-01-{1 + i % 28:02d} 03:00:00", i % 2, i % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id long, ts string, error_count int, risk_score int")
    df = df.select("user_id", F.col("ts").cast("timestamp_ntz").alias("created_at"), "error_count", "risk_score")
    df.repartition(9).write.parquet(folder)

    def run(fold):
        stream = files.read_files(spark, RUNS, folder, "*.parquet", files_per_trigger=1)
        levels.run_folded(stream, out, lambda b, _: jobs.stream_usage(b), fold, fanout=3)

    def added(parts):
        return jobs.added_up(parts, ["user_id", "day"])

    calls = []

    def dies_once(parts):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return added(parts)

    with pytest.raises(StreamingQueryException):
        run(dies_once)
    run(added)
    whole = jobs.usage_by_month(jobs.stream_usage(df))
    got = jobs.usage_by_month(levels.read_parts(spark, out))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    assert levels.manifest(spark, out)["batch"] == 8 and len(levels.manifest(spark, out)["parts"]) <= 4


# ---------------------------------------------------------------- claims


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


class Map:
    def __init__(self):
        self.rows, self.read = {}, 0

    def getValue(self, key):
        self.read += 1
        return self.rows[key]

    def updateValue(self, key, row):
        self.rows[key] = row


class Handle:
    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()


def history(period):
    state = ClaimHistory("key", "attempt", "long", 300, period)
    state.init(Handle())
    return state


@pytest.mark.parametrize("period", [1, 100, 1000, 10**9])
@pytest.mark.parametrize("seed", range(5))
def test_any_order_equals_the_whole(seed, period):
    draw = random.Random(seed)
    rows = []
    for attempt in range(300):
        done = draw.random() < 0.004
        rows.append((draw.randrange(40_000) if draw.random() < 0.9 else FREE // 2, attempt, done, not done and draw.random() < 0.2, None))
    state, seen, outcomes = history(period), [], {}
    rest = list(rows)
    while rest:
        part, rest = rest[: (n := draw.randrange(1, 30))], rest[n:]
        fresh = {}
        for row in part:
            fresh.setdefault(row[0] // period, []).append(row)
        outcomes |= dict(state.take(fresh))
        seen = sorted([*seen, *part], key=lambda r: r[:2])
        found, _ = fold([r[0] for r in seen], [r[2] for r in seen], [r[3] for r in seen], FREE, 300)
        assert outcomes == {r[1]: o for r, o in zip(seen, found, strict=True)}


def test_reads_do_not_grow_with_history():
    state, reads = history(1000), []
    for day in range(300):
        before = state.links.read + state.periods.read
        state.take({day: [(1000 * day + 400, 2 * day, False, False, None)]})
        state.take({day: [(1000 * day + 900, 2 * day + 1, False, False, None)]})
        reads.append(state.links.read + state.periods.read - before)
    assert max(reads) <= 4
    # A late attempt opens its own period; the gate meets the old one again at the next, so no other is read.
    before = state.periods.read
    assert state.take({290: [(290_950, 999, False, False, None)]}) == [(999, "in_flight")]
    assert state.periods.read - before == 1
    # One that completes the key long ago changes all that follow it, and then nothing is left to change.
    assert len(state.take({280: [(280_300, 1000, True, False, None)]})) == 1 + 2 * 20 + 1 and state.periods.read - before > 20
    assert state.links.rows[(299,)][1] == DONE


def test_many_small_batches_in_any_order(spark):
    rows = [(k if k < 4 else None, 40 * i, i, i % 29 == 28, i % 7 == 3) for i in range(240) for k in [i % 5]]
    schema = "key long, s long, attempt long, completed boolean, failed boolean"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)")).drop("s")
    folder, out = new_folder(spark, "in"), new_folder(spark, "out")
    df.repartition(12, F.xxhash64("attempt")).write.parquet(folder)
    stream = files.read_files(spark, df.schema.simpleString()[7:-1].replace(":", " "), folder, "*.parquet", files_per_trigger=1)
    path = stream_claims(stream, out, "key", "ts", "attempt", "completed", "failed", period_seconds=600, fanout=3)
    got = outcomes_of(spark, path, "key", "attempt").select("key", "attempt", "outcome").collect()
    want = claim_events(df, "key", "ts", "attempt", "completed", "failed").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 240
    parts = levels.manifest(spark, out)
    assert parts["batch"] >= 10 and len(parts["parts"]) <= 4
