"""Every bound operator against its oracle text on the same files."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from grainguard.bindings import ORACLE, QUERIES
from tests.oracle import DATA, compare, connect

FOLDER = f"{DATA}/{os.environ.get('GRAINGUARD_SF', 'sf0.001')}"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_key_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert "naive_sum" in df.columns and df.count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, con, key):
    assert compare(QUERIES[key](spark, FOLDER), con, ORACLE[key]) is None


HOT = [
    "deterministic_rank", "deterministic_rank_hot_partition", "effective_date_join", "effective_date_join_overlapping", "scd_version_inflation", "quota_gate",
    "claim_events", "claim_events_two_days", "synth_fk",
]


@pytest.mark.parametrize("key", HOT)
def test_matches_oracle_when_keys_are_hot(spark, con, every_key_hot, key):
    assert compare(QUERIES[key](spark, FOLDER), con, ORACLE[key]) is None
