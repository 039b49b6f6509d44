"""Points inside intervals of the same key, where intervals may overlap.

A range condition beside a key equality is a product of the key's points and intervals, most of which is thrown away.
Here the points of a key are numbered in order, so an interval covers a run of numbers. The run is parted into
aligned blocks of 1, 2, 4, ... numbers, at most two of each size, and a point lies in one block of each size. The
join is an equality on (key, size, block) in which every pair is a result: blocks of an interval do not overlap.
Points and intervals multiply by the logarithm of the key's points only, and a hot key is as many join keys as it
has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.plans.sorted_chunks import carry_last, exact_ranks, next_value
from grainguard.session import cut


def interval_keys(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, n, crosses) of each key: its intervals, and whether two of them overlap.

    Intervals are not empty, ``end`` is exclusive and NULL is never. If any two overlap, two neighbours by start do, so
    one look at the next row is enough.
    """
    ahead = next_value(intervals.select(key, start, end), [key], [start], start, "_next")
    open_ended = F.col(end).isNull() | (F.col(end) > F.col("_next"))
    crosses = F.coalesce(F.max(F.col("_next").isNotNull() & open_ended), F.lit(False))
    return ahead.groupBy(key).agg(F.count(F.lit(1)).alias("n"), crosses.alias("crosses"))


def _size(n: Column) -> Column:
    """Floor of the logarithm of n >= 1."""
    return F.length(F.bin(n)) - 1


def points_in_intervals(
    points: DataFrame, at: str, tiebreak: str, intervals: DataFrame, start: str, end: str, key: str, payload: str
) -> DataFrame:
    """(tiebreak, payload) of every pair with start <= at < end and the same, non-NULL key; a NULL end is never.

    ``tiebreak`` identifies a point. ``points`` and ``intervals`` hold no NULL in ``key``, ``at`` and ``start``.
    """
    ranked = cut(exact_ranks(points.select(key, at, tiebreak), [key], at, tiebreak, kinds=["row_number"]))
    ids = intervals.select(key, start, end, payload, F.monotonically_increasing_id().alias("_i"))
    ids = cut(ids)
    numbers = ranked.select(key, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.col("row_number").alias("_n"))
    none = F.lit(None).cast("long")
    bounds = [
        ids.where(F.col(bound).isNotNull()).select(key, F.col(bound).alias("_t"), F.lit(0).alias("_kind"), none.alias("_n"), "_i", F.lit(bound).alias("_bound"))
        for bound in (start, end)
    ]
    # A bound sorts before the points of its own time, so what it carries is the number of earlier points.
    merged = bounds[0].union(bounds[1]).unionByName(numbers, allowMissingColumns=True)
    carried = carry_last(merged, [key], ["_t", "_kind", "_n"], "_n", "_before").where("_kind = 0")
    runs = carried.groupBy("_i").agg(
        F.max(F.when(F.col("_bound") == start, F.coalesce("_before", F.lit(0)))).alias("_lo"),
        F.max(F.when(F.col("_bound") == end, F.coalesce("_before", F.lit(0)))).alias("_hi"),
    )
    counts = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    runs = ids.join(runs, "_i").join(counts, key).withColumn("_hi", F.coalesce("_hi", "_all")).where("_lo < _hi")

    width = F.expr("shiftleft(1L, _size)")
    sized = runs.withColumn("_size", F.explode(F.sequence(F.lit(0), _size(F.col("_hi") - F.col("_lo")))))
    sized = sized.withColumns({"_a": F.ceil(F.col("_lo") / width).cast("long"), "_b": F.floor(F.col("_hi") / width).cast("long")}).where("_a < _b")
    left = F.when(F.col("_a") % 2 == 1, F.col("_a"))
    right = F.when(F.col("_b") % 2 == 1, F.col("_b") - 1)
    blocks = sized.select(key, "_size", F.explode(F.array_compact(F.array(left, right))).alias("_block"), payload)

    places = ranked.join(counts, key).withColumn("_size", F.explode(F.sequence(F.lit(0), _size(F.col("_all")))))
    places = places.select(key, "_size", F.floor((F.col("row_number") - 1) / width).cast("long").alias("_block"), tiebreak)
    return places.join(blocks, [key, "_size", "_block"]).select(tiebreak, payload)
