"""Counts passed up random join trees equal COUNT on the joined rows."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from grainguard.operators.jointrees import Joined, join_tree_proof


def table(spark, draw, rows=25):
    return spark.createDataFrame(
        [(i, *(draw.choice((None, 0, 1, 2, 3)) for _ in "abc")) for i in range(rows)], "id long, a long, b long, c long"
    )


def tree(spark, draw, depth):
    joins = []
    for _ in range(2 if depth == 2 else draw.choice((0, 1, 2))):
        keys, on = draw.choice((("a", "b"), ("a", "a"), (["a", "b"], ["b", "c"])))
        rows = draw.choice((1, 4, 25)) if depth == 2 else 8
        joins.append(Joined(table(spark, draw, rows), keys, on, draw.choice(("inner", "left", "left")), tree(spark, draw, depth - 1) if depth else ()))
    return tuple(joins)


def renamed(df, n):
    return df.select(*(F.col(c).alias(f"{c}{n}") for c in df.columns))


def built(df, prefix, joins, counter, nested):
    """The joins themselves: nested, or one after the other."""
    for join in joins:
        counter[0] += 1
        n = counter[0]
        keys = [join.keys] if isinstance(join.keys, str) else join.keys
        on = [join.on] if isinstance(join.on, str) else join.on
        condition = F.lit(True)
        for k, o in zip(keys, on):
            condition = condition & (F.col(f"{k}{n}") == F.col(f"{o}{prefix}"))
        side = renamed(join.df, n)
        if nested:
            df = df.join(built(side, n, join.joins, counter, True), condition, join.how)
        else:
            df = built(df.join(side, condition, join.how), n, join.joins, counter, False)
    return df


@pytest.mark.parametrize("nested", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_random_trees(spark, seed, nested):
    draw = random.Random(seed)
    fact = table(spark, draw, 40).withColumn("id", F.col("id") % 30)
    joins = tree(spark, draw, 2)
    want = built(renamed(fact, 0), 0, joins, [0], nested).agg(F.count(F.lit(1)), F.count_distinct("id0")).first()
    got = join_tree_proof(fact, "id", joins, nested=nested).first()
    assert (int(got["joined_rows"]), got["grain_rows"]) == tuple(want)
    assert got["factor"] == pytest.approx(want[0] / max(1, want[1]))


def test_hot_keys_do_not_overflow(spark):
    hot = spark.range(3000).select(F.lit(1).alias("k"), "id")
    joins = [Joined(hot, "k", "k") for _ in range(6)]
    got = join_tree_proof(hot, "id", joins, pk_unique=True).first()
    assert got["joined_rows"] == Decimal(3000) ** 7 and got["grain_rows"] == 3000


def test_left_below_inner_and_empty_sides(spark):
    fact = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, k long")
    empty = fact.where("false")
    none = join_tree_proof(fact, "id", [Joined(empty, "k", "k")]).first()
    assert tuple(none) == (0, 0, 0.0)
    assert tuple(join_tree_proof(fact, "id", [Joined(empty, "k", "k", "left")]).first()) == (3, 3, 1.0)
    assert tuple(join_tree_proof(empty, "id", []).first()) == (0, 0, 0.0)
    # In parentheses, a left-joined table whose own inner join fails is missing as a whole; without, its rows are gone.
    missing = Joined(fact, "k", "k", "left", (Joined(empty, "k", "k"),))
    assert tuple(join_tree_proof(fact, "id", [missing], nested=True).first()) == (3, 3, 1.0)
    assert tuple(join_tree_proof(fact, "id", [missing]).first()) == (0, 0, 0.0)


def test_null_and_repeated_primary_keys(spark):
    fact = spark.createDataFrame([(None, 1), (1, 1), (1, 1), (2, None)], "id long, k long")
    side = spark.createDataFrame([(1,), (1,)], "k long")
    assert tuple(join_tree_proof(fact, "id", [Joined(side, "k", "k")]).first()) == (6, 1, 6.0)


def test_wrong_trees_are_refused(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        Joined(df, "id", "id", "full")
    with pytest.raises(ValueError):
        Joined(df, ["id"], ["id", "id"])
