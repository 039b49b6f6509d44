"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainguard.llm.columns import stored


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node links its larger neighbours (or its smaller ones and itself) to its least neighbour."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is reachable, for every node that has a link to another.

    ``edges`` has columns ``u`` and ``v`` (long, not NULL); direction, repeats and loops do not matter. The rounds
    end when the links are stars; their number grows with the logarithm of the nodes. Every round is written, so
    a lost executor costs one round at most. A hub is one row after the map-side minimum, and its links are split
    as a skewed join side.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    while True:
        edges = stored(stars(stars(edges, True), False), "links")
        state = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # one row
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
