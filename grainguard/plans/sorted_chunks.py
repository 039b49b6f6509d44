"""Ordered work (ranks, as-of lookups, folds) without one task per key.

A window ``partitionBy(key)`` puts all rows of a key into one task. That is the
cheapest plan while keys are small, and fails when one key holds a third of a
table. So keys are counted first (map-side combined). If any key is hot, rows
are range-partitioned by (key, order) instead: a hot key then spans many
partitions ("chunks"). Each chunk is worked on alone and a summary of at most
one row per (key, chunk) carries what the later chunks need to know.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainguard.session import cut

CHUNK = "_chunk"

# More rows than this in one key, and the key is spread over chunks. One window
# task sorts so many rows with a few spills. Sessions may set their own limit.
HOT_KEY_ROWS = 5_000_000
CHUNK_ROWS = 5_000_000
HOT_KEY_SETTING = "spark.grainguard.hotKeyRows"


def any_over_limit(counts: DataFrame, n: str) -> bool:
    """Is one of these row counts more than a window task should get?"""
    limit = int(counts.sparkSession.conf.get(HOT_KEY_SETTING, str(HOT_KEY_ROWS)))
    return not counts.where(F.col(n) > limit).isEmpty()


def has_hot_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """Does one key own too many rows for one task? Runs one map-side combined count per key."""
    return not keys or any_over_limit(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "n")


def sorted_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sort_inside: bool = False
) -> DataFrame:
    """Add ``_chunk``: chunks of one key are numbered in the given order and never overlap.

    The result is cut: range bounds are sampled, and both the per-chunk work and
    the summary have to see the same chunk numbers.
    """
    cols = [*keys, *order]
    # As many as the rows ask for. A stated number is kept by adaptive execution, so small rows with much work
    # still use all cores.
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = df.repartitionByRange(max(least, -(-df.count() // CHUNK_ROWS)), *cols)
    if sort_inside:
        chunks = chunks.sortWithinPartitions(*cols)
    return cut(chunks.withColumn(CHUNK, F.spark_partition_id()))


def earlier_chunks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def exact_ranks(
    df: DataFrame,
    part: Sequence[str],
    order: str,
    tiebreak: str,
    descending: bool = False,
    kinds: Sequence[str] = ("row_number", "rank", "dense_rank"),
    hot: bool | None = None,
) -> DataFrame:
    """Add the ranking columns named in ``kinds`` over ``part`` ordered by ``order`` then ``tiebreak``.

    Equal to the window functions of the same names (row_number uses the
    tie-breaker, rank and dense_rank only ``order``). ``part + order + tiebreak``
    should be unique, otherwise row_number is arbitrary among equals. A caller
    that already has the counts says whether a partition is ``hot``.
    """
    part = list(part)
    direction = F.desc if descending else F.asc
    if not (has_hot_key(df, part) if hot is None else hot):
        whole = Window.partitionBy(*part)
        ranks = {
            "row_number": F.row_number().over(whole.orderBy(direction(order), F.asc(tiebreak))),
            "rank": F.rank().over(whole.orderBy(direction(order))),
            "dense_rank": F.dense_rank().over(whole.orderBy(direction(order))),
        }
        return df.select("*", *[ranks[k].cast("bigint").alias(k) for k in kinds])
    rows = sorted_chunks(df, part, [direction(order), F.asc(tiebreak)])
    local = Window.partitionBy(*part, CHUNK)
    ordered = local.orderBy(direction(order), F.asc(tiebreak))
    by_value = local.orderBy(direction(order))

    if set(kinds) == {"row_number"}:
        summary = rows.groupBy(*part, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
        offsets = summary.select(
            *part, CHUNK, F.coalesce(F.sum("_n").over(earlier_chunks(part)), F.lit(0)).alias("_before")
        )
        out = rows.withColumn("_local", F.row_number().over(ordered)).join(_null_safe(offsets, part), *_on(rows, part))
        return _tidy(out.withColumn("row_number", F.col("_before") + F.col("_local")), df, kinds)

    # One row per (part, chunk, order value) first, so ties are combined map-side.
    values = rows.groupBy(*part, CHUNK, order).agg(F.count(F.lit(1)).alias("_n"))
    value = F.struct(F.col(order).alias("v"))
    first, last = (F.max, F.min) if descending else (F.min, F.max)
    n_last = (F.min_by if descending else F.max_by)("_n", value)
    summary = values.groupBy(*part, CHUNK).agg(
        F.sum("_n").alias("_n"),
        F.count(F.lit(1)).alias("_d"),
        first(value).alias("_first"),
        last(value).alias("_last"),
        n_last.alias("_n_last"),
    )
    steps = Window.partitionBy(*part).orderBy(CHUNK)
    before = earlier_chunks(part)
    summary = summary.withColumn("_goes_on", F.coalesce(F.col("_first") == F.lag("_last").over(steps), F.lit(False)))
    summary = summary.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_d_before",
        F.coalesce(F.sum(F.col("_d") - F.col("_goes_on").cast("int")).over(before), F.lit(0))
        - F.col("_goes_on").cast("int"),
    )
    # Where the run of equal values that is open at the end of a chunk began; NULL if it began earlier.
    opened = F.when(
        ~(F.col("_goes_on") & (F.col("_d") == 1)), F.col("_before") + F.col("_n") - F.col("_n_last")
    )
    summary = summary.withColumn("_opened", opened).withColumn(
        "_run_start", F.when(F.col("_goes_on"), F.last("_opened", ignorenulls=True).over(before))
    )
    offsets = summary.select(*part, CHUNK, "_before", "_d_before", "_run_start")
    out = (
        rows.withColumn("_local", F.row_number().over(ordered))
        .withColumn("_local_rank", F.rank().over(by_value))
        .withColumn("_local_dense", F.dense_rank().over(by_value))
        .join(_null_safe(offsets, part), *_on(rows, part))
        .withColumn("row_number", F.col("_before") + F.col("_local"))
        .withColumn(
            "rank",
            F.when((F.col("_local_dense") == 1) & F.col("_run_start").isNotNull(), F.col("_run_start") + 1).otherwise(
                F.col("_before") + F.col("_local_rank")
            ),
        )
        .withColumn("dense_rank", F.col("_d_before") + F.col("_local_dense"))
    )
    return _tidy(out, df, kinds)


def _null_safe(offsets: DataFrame, part: Sequence[str]) -> DataFrame:
    return offsets.select(*[F.col(c).alias(f"_o_{c}") for c in [*part, CHUNK]], *[c for c in offsets.columns if c not in {*part, CHUNK}])


def _on(rows: DataFrame, part: Sequence[str]):
    # The chunk is never NULL, so it is the hash key; a NULL part value still has to meet its own summary row.
    condition = F.col(CHUNK) == F.col(f"_o_{CHUNK}")
    for c in part:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return condition, "inner"


def _tidy(out: DataFrame, df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return out.select(*df.columns, *kinds)


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` at or before each row, in ``order`` within ``keys``.

    The linear form of an as-of lookup; no row meets more than one other row.
    """
    keys = list(keys)
    if not has_hot_key(df, keys):
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    rows = sorted_chunks(df, keys, order)
    local = (
        Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ends = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, CHUNK)
        .agg(F.max_by(value, F.struct(*order)).alias("_end"))
    )
    chunks = rows.groupBy(*keys, CHUNK).agg(F.lit(1).alias("_one"))
    carried = (
        chunks.join(_null_safe(ends, keys), _on(chunks, keys)[0], "left")
        .select(*keys, CHUNK, F.last("_end", ignorenulls=True).over(earlier_chunks(keys)).alias("_carried"))
        .where(F.col("_carried").isNotNull())
    )
    return (
        rows.withColumn("_local", F.last(value, ignorenulls=True).over(local))
        .join(_null_safe(carried, keys), _on(rows, keys)[0], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .select(*df.columns, name)
    )


def next_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the following row, in ``order`` within ``keys``; NULL on the last row.

    ``keys + order`` has to be unique.
    """
    keys = list(keys)
    if not has_hot_key(df, keys):
        return df.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = sorted_chunks(df, keys, order)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    starts = rows.groupBy(*keys, CHUNK).agg(F.min_by(F.struct(value), F.struct(*order)).alias("_start"))
    following = starts.select(
        *keys, CHUNK, F.lead("_start").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_following")
    ).where(F.col("_following").isNotNull())
    return (
        rows.withColumn("_local", F.lead(F.struct(value)).over(local))
        .join(_null_safe(following, keys), _on(rows, keys)[0], "left")
        .withColumn(name, F.coalesce("_local", "_following")[value])
        .select(*df.columns, name)
    )
