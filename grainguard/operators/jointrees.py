"""Fan-out of any acyclic join graph of inner and left joins, counted without building a join.

The graph is a tree: every joined table hangs on one that was joined before it. A row of a table stands for as many
joined rows as the product, over the tables that hang on it, of what their matching rows stand for. So counts are
passed up: each table is reduced to one number per key it is joined on. No step is larger than its table, and a hot
key is one row after the map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.plans.shapes import WIDE, as_list, not_null, ratio

Keys = str | Sequence[str]


@dataclass(frozen=True)
class Joined:
    """A table joined to the one it hangs on: ``keys`` of its own equal ``on`` of the other one, both in order.

    ``how`` is inner or left. Filters belong into ``df`` before; one on a left-joined table that NULLs do not pass makes it inner.
    """

    df: DataFrame
    keys: Keys
    on: Keys
    how: str = "inner"
    joins: tuple[Joined, ...] = ()

    def __post_init__(self):
        if self.how not in ("inner", "left"):
            raise ValueError(f"join type {self.how!r} is neither inner nor left")
        if len(as_list(self.keys)) != len(as_list(self.on)):
            raise ValueError("as many keys as columns they are joined on")


def _product(a: Column, b: Column) -> Column:
    return (a * b).cast(WIDE)


def _standing_for(df: DataFrame, own: dict[str, str], joins: Sequence[Joined]) -> DataFrame:
    """Rows of ``df`` by ``own`` (name in the result -> column), each group's ``n`` what its rows stand for.

    Groups that an inner join leaves without a match are gone; NULL keys match nothing.
    """
    links = [{f"j{i}_{k}": c for k, c in enumerate(as_list(join.on))} for i, join in enumerate(joins)]
    wanted = own | {name: c for link in links for name, c in link.items()}
    counts = df.select(*(F.col(c).alias(name) for name, c in wanted.items())).groupBy(*wanted).agg(F.count(F.lit(1)).cast(WIDE).alias("n"))
    for link, join in zip(links, joins, strict=True):
        below = _weights(join).select(*(F.col(f"k{k}").alias(name) for k, name in enumerate(link)), F.col("n").alias("m"))
        counts = counts.join(below, list(link), join.how)
        counts = counts.withColumn("n", _product(F.col("n"), F.coalesce("m", F.lit(1).cast(WIDE)))).drop("m")
    return counts.select(*own, "n")


def _weights(join: Joined) -> DataFrame:
    """What the rows of a joined table stand for, per key they are joined on."""
    names = {f"k{k}": c for k, c in enumerate(as_list(join.keys))}
    rows = _standing_for(join.df.where(not_null(list(names.values()))), names, join.joins)
    return rows.groupBy(*names).agg(F.sum("n").cast(WIDE).alias("n"))


def in_a_row(joins: Sequence[Joined]) -> tuple[Joined, ...]:
    """Joins as a FROM list without parentheses applies them: an inner join on a left-joined table drops the rows
    without it, so whatever has an inner join above it on its branch is inner as well."""
    out = []
    for join in joins:
        below = in_a_row(join.joins)
        how = "inner" if any(b.how == "inner" for b in below) else join.how
        out.append(replace(join, how=how, joins=below))
    return tuple(out)


def join_tree_proof(
    fact: DataFrame, pk: Keys, joins: Sequence[Joined], pk_unique: bool = False, nested: bool = False
) -> DataFrame:
    """COUNT(*) of the joined rows beside COUNT(DISTINCT primary key) of the fact, and their ratio.

    Tables are joined one after the other, as a FROM list has them; with ``nested`` what hangs on a table is joined to it
    first, as parentheses would, and a left join keeps or loses that whole.

    With ``pk_unique`` the surviving fact rows are counted, otherwise their distinct keys; a NULL in the key is no
    grain. An empty result has 0 rows, 0 grains and factor 0.
    """
    keys = {f"p{k}": c for k, c in enumerate(as_list(pk))}
    rows = _standing_for(fact, keys, joins if nested else in_a_row(joins))
    if not pk_unique:
        rows = rows.groupBy(*keys).agg(F.sum("n").cast(WIDE).alias("n"))
    both = rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast(WIDE).alias("joined_rows"), F.count_if(not_null(list(keys))).alias("grain_rows")
    )
    return both.select("joined_rows", "grain_rows", ratio("joined_rows", F.greatest(F.lit(1), F.col("grain_rows"))).alias("factor"))
