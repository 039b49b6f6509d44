"""Event claims by the array fold and by the marked chain: both equal the attempts taken one by one."""

import datetime
import random

import pytest

from grainguard.operators.claims import DONE, FREE, claim_events, gate_after

SCHEMA = "key long, ts timestamp_ntz, attempt long, completed boolean, failed boolean"
START = datetime.datetime(2024, 1, 1)
STALE = 300_000_000


def one_by_one(rows):
    gates, found = {}, {}
    for key, micros, attempt, done, failed in sorted(rows, key=lambda r: (r[1], r[2])):
        gate = gates.get(key, FREE)
        if gate == DONE:
            found[key, attempt] = "duplicate"
        elif micros < gate:
            found[key, attempt] = "in_flight"
        else:
            found[key, attempt] = "processed" if gate == FREE else "reclaimed"
            gates[key] = gate_after(micros, bool(done), bool(failed), STALE)
    return found


def outcomes(spark, rows):
    df = spark.createDataFrame([(k, START + datetime.timedelta(microseconds=m), a, d, f) for k, m, a, d, f in rows], SCHEMA)
    df = claim_events(df.repartition(4), "key", "ts", "attempt", "completed", "failed")
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()
    got = df.collect()
    assert len(got) == len(rows)
    return {(r["key"], r["attempt"]): r["outcome"] for r in got}


def attempts(seed, step):
    """A key of bursts and gaps, a regular one whose chains from different starts never meet, one that fails a lot, a NULL one."""
    draw = random.Random(seed)
    rows = []
    for key, n, done, failed in ((0, 400, 0.002, 0.1), (1, 300, 0.0, 0.0), (2, 200, 0.01, 0.7), (None, 150, 0.01, 0.2), (3, 1, 1, 0), (4, 3, 0, 1)):
        at = 0
        for attempt in range(n):
            at += step if key == 1 else draw.choice((0, 1, step, 7 * step, 2 * STALE if draw.random() < 0.1 else step))
            completed = draw.random() < done
            rows.append((key, at, attempt, completed, None if not failed else not completed and draw.random() < failed))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("step", [1_000_000, 60_000_000, 299_999_999, 300_000_000])
def test_chain(spark, every_key_hot, step):
    rows = attempts(step, step)
    assert outcomes(spark, rows) == one_by_one(rows)


def test_fold(spark):
    rows = attempts(5, 60_000_000)
    got = outcomes(spark, rows)
    assert got == one_by_one(rows) and len(set(got.values())) == 4


def test_a_key_longer_than_an_array_beside_short_ones(spark, monkeypatch):
    from grainguard.operators import claims

    monkeypatch.setattr(claims, "FOLDED", 250)
    rows = attempts(6, 60_000_000)
    assert outcomes(spark, rows) == one_by_one(rows)


def test_no_attempts(spark):
    assert outcomes(spark, []) == {}


def test_a_key_of_thousands_of_attempts_is_folded(spark, monkeypatch):
    """Its time grows with its attempts: neither the doubled steps of a chain nor an outcome put to all before it."""
    from grainguard.operators import claims

    monkeypatch.setattr(claims, "chained", None)
    draw = random.Random(7)
    month = 30 * 86_400_000_000
    rows = [(key, at := draw.randrange(month), attempt, key == 1 and at > month // 2, False) for key in (0, 1) for attempt in range(6000)]
    got = outcomes(spark, rows)
    assert got == one_by_one(rows) and len(set(got.values())) == 4


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_pieces_of_a_fold(spark, monkeypatch, piece):
    from grainguard.operators import claims

    monkeypatch.setattr(claims, "PIECE", piece)
    rows = attempts(8, 60_000_000)
    assert outcomes(spark, rows) == one_by_one(rows)
