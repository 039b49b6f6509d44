"""Closest-name search without name pairs: each name meets arrays of candidates, never rows of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.plans.shapes import array_shards


def accepted_distance(a: Column, b: Column) -> Column:
    """Largest edit distance accepted for names of these lengths: 3, or 40 % of the longer one."""
    return F.greatest(F.lit(3), F.ceil(F.greatest(a, b).cast("double") * F.lit(0.4)))


def closest(name: Column, candidates: Column) -> Column:
    """Struct (d, ord, candidate) of the nearest entry of an array of (ord, candidate), first in order on ties."""
    return F.array_min(
        F.transform(
            candidates,
            lambda c: F.struct(
                F.levenshtein(F.lower(name), F.lower(c["candidate"])).alias("d"),
                c["ord"].alias("ord"),
                c["candidate"].alias("candidate"),
            ),
        )
    )


def nearest_name(
    names: DataFrame, candidates: DataFrame, name: str, candidate: str, order: str, within: Sequence[str] = ()
) -> DataFrame:
    """Nearest candidate per distinct name (and per ``within`` group, such as the table a column belongs to).

    Result: within..., name, nearest; ``nearest`` is NULL when the best one is too
    far. Only candidate lengths that can hold the best acceptable candidate are
    visited, found by an equi join on length; each visit compares one name with
    one array of at most about a thousand candidates.
    """
    within = list(within)
    wanted = names.select(*within, name).where(F.col(name).isNotNull()).distinct()
    first = candidates.groupBy(*within, candidate).agg(F.min(order).alias("ord"))
    shards = array_shards(
        first.withColumn("_len", F.length(candidate)),
        [*within, "_len"],
        F.struct("ord", F.col(candidate).alias("candidate")),
        "_candidates",
    )
    size = F.length(name)
    # A candidate longer than this is never accepted; one further away than the
    # distance accepted at that length can never beat an accepted one.
    longest = F.greatest(size + 3, F.ceil((size + 1) / F.lit(0.6))).cast("int")
    reach = accepted_distance(size, longest).cast("int")
    visits = wanted.withColumn("_len", F.explode(F.sequence(F.greatest(F.lit(0), size - reach), longest)))
    best = (
        visits.join(shards, [*within, "_len"])
        .select(*within, name, closest(F.col(name), F.col("_candidates")).alias("_best"))
        .groupBy(*within, name)
        .agg(F.min("_best").alias("_best"))
    )
    near = F.col("_best.d") <= accepted_distance(F.length(name), F.length("_best.candidate"))
    return best.select(*within, name, F.when(near, F.col("_best.candidate")).alias("nearest"))
