"""Small plan shapes reused by the operators: key counts, one-row results, array shards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.plans.sorted_chunks import any_over_limit

WIDE = "decimal(38,0)"


def as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def not_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def keyed(df: DataFrame, keys: Sequence[str], *extra: str) -> DataFrame:
    """Project the keys to ``k0, k1, ...`` plus the columns an audit needs, nothing else."""
    return df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *extra)


def key_names(keys: Sequence[str]) -> list[str]:
    return [f"k{i}" for i in range(len(keys))]


def key_counts(df: DataFrame, keys: str | Sequence[str], name: str) -> DataFrame:
    """Rows per non-null key: one map-side combined aggregate, at most one row per key to shuffle."""
    keys = as_list(keys)
    names = key_names(keys)
    return keyed(df, keys).where(not_null(names)).groupBy(*names).agg(F.count(F.lit(1)).alias(name))


def times(*factors: Column | str) -> Column:
    """Product of counts in DECIMAL(38,0); BIGINT would overflow on one hot key times another."""
    cols = [F.col(f) if isinstance(f, str) else f for f in factors]
    return reduce(lambda a, b: (a * b).cast(WIDE), [c.cast("decimal(20,0)") for c in cols])


def total(c: Column | str) -> Column:
    """Sum that is 0, not NULL, on no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as DOUBLE, NULL when b is 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Put one-row frames next to each other without a cross join.

    Each frame fills its own columns; a union keeps the others NULL and one
    final aggregate over as many rows as there are frames folds them together.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def unpivot_row(df: DataFrame, label: str, parts: dict[str, dict[str, Column]]) -> DataFrame:
    """Turn one wide row into one row per entry of ``parts`` (label -> named columns)."""
    entries = [
        F.struct(F.lit(name).alias(label), *[c.alias(n) for n, c in cols.items()]) for name, cols in parts.items()
    ]
    return df.select(F.inline(F.array(*entries)))


def salted_left_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join on a key that may be hot in ``big`` and is unique in ``small``.

    Rows of one key are spread over ``salts`` partitions and ``small`` is copied to each of them, so an
    aggregate on the same key first combines in many tasks. The engine takes the copies for no larger than ``small``,
    and would broadcast all of them through the driver, so a merge join is asked for.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies.hint("merge"), [key, "_salt"], "left").drop("_salt")


# Names and hints of this many rows are a few MB; only then is a side broadcast by hint.
SMALL_ROWS = 100_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Counts at most ``rows`` + 1 rows; for frames that are already materialised."""
    return df.limit(rows + 1).count() <= rows


# Rows of a join's task that is sorted in some 100 MB.
TASK_ROWS = 1_000_000


def dealt(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi join, in as many partitions as ``rows`` ask for; ``rows`` are counted, ``other`` is materialised.

    Adaptive execution sizes tasks by compressed bytes, and rows whose columns repeat themselves may be ten times larger
    when they are sorted. A stated number is kept. Sides that are left to it as they are: where ``other`` is small, as it
    will be broadcast, and where a hot key would fill a task, as only its own exchanges are split.
    """
    n = -(-rows.count() // TASK_ROWS)
    if n <= 1 or is_small(other):
        return rows, other
    tasks = rows.groupBy(F.pmod(F.hash(key), F.lit(n)).alias("task")).agg(F.count(F.lit(1)).alias("n"))
    if any_over_limit(tasks, "n"):
        return rows, other
    return rows.repartition(n, key), other.repartition(n, other_key)


def array_shards(df: DataFrame, by: Sequence[str], item: Column, name: str, size: int = 1000) -> DataFrame:
    """Collect distinct ``item`` values per group into arrays of about ``size`` elements.

    A group larger than ``size`` is spread over hash shards, so no array and no
    task grows with a hot group.
    """
    by = list(by)
    distinct = df.select(*by, item.alias(name)).distinct()
    sizes = distinct.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("_shards"))
    return (
        distinct.join(sizes, by)
        .withColumn("shard", F.pmod(F.xxhash64(name), F.col("_shards")))
        .groupBy(*by, "shard")
        .agg(F.collect_list(name).alias(name))
    )
