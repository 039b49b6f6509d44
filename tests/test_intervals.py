"""Effective-date joins of overlapping histories equal the range join."""

import datetime
import random

import pytest

from grainguard.operators.joins import effective_date_join

START = datetime.datetime(2024, 1, 1)


def at(n):
    return None if n is None else START + datetime.timedelta(hours=n)


def histories(seed, overlap):
    draw = random.Random(seed)
    facts = [(draw.choice((0, 0, 0, 1, 2, 5, None)), at(draw.choice((None, draw.randrange(200), draw.randrange(20)))), i) for i in range(400)]
    versions = [(1, None, at(9), "never"), (1, None, None, "no start"), (1, at(5), at(5), "empty"), (1, at(9), at(3), "backwards"), (None, at(0), None, "no key")]
    for k in (0, 1, 2, 3):
        n = 60 if k == 0 else 5
        starts = sorted(draw.sample(range(180), n))
        for i, a in enumerate(starts):
            end = a + draw.randrange(1, 90) if overlap(k) else (starts[i + 1] if i + 1 < n else None)
            versions.append((k, at(a), None if overlap(k) and draw.random() < 0.1 else at(end), f"{k}-{i}"))
    versions += [(2, at(7), at(80), "2-same"), (2, at(7), at(80), "2-same")] if overlap(2) else []
    return facts, versions


def brute(facts, versions):
    return sorted(
        (i, name) for k, t, i in facts for key, a, b, name in versions
        if k is not None and k == key and t is not None and a is not None and a <= t and (b is None or t < b)
    )


def joined(spark, facts, versions):
    f = spark.createDataFrame(facts, "k long, t timestamp_ntz, id long").repartition(3)
    v = spark.createDataFrame(versions, "k long, a timestamp_ntz, b timestamp_ntz, name string").repartition(3)
    got = effective_date_join(f, "k", "t", v, "k", "a", "b", ["name"])
    assert got.columns == ["k", "t", "id", "name"]
    return sorted((r["id"], r["name"]) for r in got.collect())


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("overlap", [lambda k: True, lambda k: k != 0, lambda k: k == 0, lambda k: False], ids=["all", "small", "hot", "none"])
def test_equals_the_range_join(spark, request, hot, overlap):
    if hot:
        request.getfixturevalue("every_key_hot")
    facts, versions = histories(3, overlap)
    want = brute(facts, versions)
    assert want and joined(spark, facts, versions) == want


def test_version_inside_another(spark):
    facts, versions = [(1, at(7), 0), (1, at(3), 1)], [(1, at(0), at(10), "outer"), (1, at(2), at(5), "inner")]
    assert joined(spark, facts, versions) == [(0, "outer"), (1, "inner"), (1, "outer")]


def test_empty_sides(spark):
    assert joined(spark, [], histories(3, lambda k: True)[1]) == []
    assert joined(spark, histories(3, lambda k: True)[0], []) == []


def test_every_joined_pair_is_a_result(spark):
    """No pair is made to be thrown away: the block join's rows are the result's rows."""
    from grainguard.plans.intervals import points_in_intervals

    n = 500
    points = spark.range(n).selectExpr("1 AS k", "id AS t", "id")
    spans = spark.range(n).selectExpr("1 AS k", "id AS a", "id + 1 + id % 3 AS b", "id AS v")
    got = points_in_intervals(points, "t", "id", spans, "a", "b", "k", "v")
    assert got.count() == sum(1 for i in range(n) for d in range(1 + i % 3) if i + d < n)
    assert got.distinct().count() == got.count()


def test_few_versions_of_a_key_are_met_at_once(spark, monkeypatch):
    """Facts of short histories move once: they are neither numbered nor written nor dealt to blocks."""
    from grainguard.operators import joins

    facts, versions = histories(4, lambda k: True)
    versions = [v for v in versions if v[0] != 0 or int(v[3].split("-")[1]) < 25]
    written, cut = [], joins.cut
    monkeypatch.setattr(joins, "points_in_intervals", None)
    monkeypatch.setattr(joins, "cut", lambda df: written.append(df.columns) or cut(df))
    want = brute(facts, versions)
    assert want and joined(spark, facts, versions) == want
    assert written == [["_key", "n", "crosses"]]


@pytest.mark.parametrize("few", [1, 5, 60])
def test_either_side_of_few(spark, monkeypatch, few):
    from grainguard.operators import joins

    monkeypatch.setattr(joins, "FEW_VERSIONS", few)
    facts, versions = histories(5, lambda k: k in (0, 1))
    want = brute(facts, versions)
    assert want and joined(spark, facts, versions) == want
