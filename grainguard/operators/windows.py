"""Ranking and paging: where an order is not total, and the repaired forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.plans.shapes import ratio, total
from grainguard.plans.sorted_chunks import exact_ranks


def rank_tie_audit(df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Tied groups, tied rows and the partitions they touch. Counts only; no window is run."""
    sizes = df.groupBy(*part, *order).agg(F.count(F.lit(1)).alias("n"))
    tied = F.col("n") > 1
    per_part = sizes.groupBy(*part).agg(
        F.sum("n").alias("rows"),
        F.count_if(tied).alias("tie_groups"),
        total(F.when(tied, F.col("n"))).alias("tied_rows"),
        F.max("n").alias("largest"),
    )
    return per_part.agg(
        F.count(F.lit(1)).alias("partitions"),
        total("rows").alias("rows"),
        total("tie_groups").alias("tie_groups"),
        total("tied_rows").alias("tied_rows"),
        F.count_if(F.col("tie_groups") > 0).alias("partitions_affected"),
        F.max("largest").alias("largest_tie"),
    )


def deterministic_rank(
    df: DataFrame, part: Sequence[str], order: str, tiebreak: str, descending: bool = False
) -> DataFrame:
    """row_number, rank and dense_rank made repeatable by a unique tie-breaker, at any partition size."""
    return exact_ranks(df, part, order, tiebreak, descending)


def unordered_window_audit(df: DataFrame, part: Sequence[str]) -> DataFrame:
    """Partitions and rows whose row numbers would be arbitrary without ORDER BY."""
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") > 1
    return sizes.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.count_if(many).alias("partitions_at_risk"),
        total(F.when(many, F.col("n"))).alias("rows_at_risk"),
        ratio(total(F.when(many, F.col("n"))), F.sum("n")).alias("share_at_risk"),
    )


def qualify_latest(df: DataFrame, part: Sequence[str], order: str, tiebreak: str) -> DataFrame:
    """The latest row per partition (QUALIFY row_number() ... = 1) in one exchange.

    An aggregate that combines before it shuffles; the engine sorts for it, as structs do not fit its hash buffers.
    """
    rest = [c for c in df.columns if c not in part]
    best = F.max_by(F.struct(*rest), F.struct(order, tiebreak))
    return df.groupBy(*part).agg(best.alias("_best")).select(*part, "_best.*").select(*df.columns)


def page(df: DataFrame, order: Sequence[Column | str], offset: int, n: int) -> DataFrame:
    """One page of a totally ordered result; each task keeps only its first offset + n rows."""
    return df.orderBy(*order).offset(offset).limit(n)


def flatten_json(df: DataFrame, col: str, value_type: str) -> DataFrame:
    """A JSON object or array of scalars in a text column to one row per entry; other columns stay.

    Rows with NULL, empty or broken JSON stay once with NULL entries.
    """
    keep = [c for c in df.columns if c != col]
    text = F.col(col)
    is_array = F.coalesce(F.ltrim(text).startswith("["), F.lit(False))
    items = F.from_json(F.when(is_array, text), f"array<{value_type}>")
    pairs = F.from_json(F.when(~is_array, text), f"map<string,{value_type}>")
    entries = F.when(
        is_array, F.transform(items, lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
    ).otherwise(F.map_entries(pairs))
    return df.select(*keep, F.explode_outer(entries).alias("_e")).select(*keep, "_e.key", "_e.value")
