"""Constraint-respecting tables of any size: one Spark job per table, every value a function of its row id."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainguard.functions import pools as P
from grainguard.functions.draws import Draws
from grainguard.operators.joins import fanout_proof
from grainguard.plans.shapes import ratio, total
from grainguard.plans.sorted_chunks import exact_ranks

DEFAULT_ROWS = 100


@dataclass(frozen=True)
class ColumnSpec:
    """One column of a table to generate. ``allowed`` is its CHECK list."""

    name: str
    type: str
    nullable: bool = True
    is_pk: bool = False
    is_fk: bool = False
    fk_table: str | None = None
    fk_column: str | None = None
    allowed: tuple[str, ...] = ()


def column_specs(catalog: DataFrame, table: str) -> list[ColumnSpec]:
    """Specs of one table from folded catalog rows. Reads that table's few rows to build the plan."""
    rows = catalog.where(F.col("table_name") == table).orderBy("ord").collect()
    return [
        ColumnSpec(r["column_name"], r["type"], r["nullable"], r["is_pk"], r["is_fk"], r["fk_table"], r["fk_column"])
        for r in rows
    ]


def row_ids(spark: SparkSession, n: int = DEFAULT_ROWS) -> DataFrame:
    """Row ids 1..n, generated in parallel."""
    return spark.range(1, n + 1)


# ---------------------------------------------------------------- values

_INTEGER = re.compile(r"serial|^(int|integer|bigint|smallint)$")
_FRACTION = re.compile(r"^(numeric|decimal|real|float)|double")


def _two_decimals(c: Column) -> Column:
    return F.floor(c * 100 + F.lit(0.5)).cast("double") / 100


def _past(d: Draws) -> Column:
    """A midnight 0 to 365 days before the fixed day 2026-06-01."""
    days = d.integer(0, 365)
    return F.to_timestamp_ntz(F.lit("2026-06-01 00:00:00")) - F.make_dt_interval(days.cast("int"))


def _email(d: Draws) -> Column:
    return F.concat(F.lower(d.pick(P.FIRST_NAMES)), d.integer(1, 999, 1).cast("string"), F.lit("@"), d.pick(P.DOMAINS, 2))


def _login(d: Draws) -> Column:
    return F.concat(F.lower(d.pick(P.FIRST_NAMES)), d.integer(1, 99, 1).cast("string"))


def _company(d: Draws) -> Column:
    return F.concat_ws(" ", d.pick(P.LAST_NAMES), d.pick(P.COMPANY_SUFFIXES, 1))


def _person(d: Draws) -> Column:
    return F.concat_ws(" ", d.pick(P.FIRST_NAMES), d.pick(P.LAST_NAMES, 1))


def _street(d: Draws) -> Column:
    return F.concat_ws(" ", d.integer(1, 9999).cast("string"), d.pick(P.STREET_NAMES, 1), d.pick(P.STREET_TYPES, 2))


def _phone(d: Draws) -> Column:
    # Two draws, because ten digits do not fit one.
    return F.concat(F.lit("+1"), d.integer(20_000, 99_999).cast("string"), F.lpad(d.integer(0, 99_999, 1).cast("string"), 5, "0"))


def _of(words: Sequence[str]) -> Callable[[Draws], Column]:
    return lambda d: d.pick(words)


# A column called name, full_name or ..._name: what kind of name it holds.
_A_NAME = r"^name$|full_?name|_name$"
# Name rules in order of precedence: pattern, value, and whether the column must be a number.
# What a column's name says about its content, first match first.
NAME_RULES: tuple[tuple[str, Callable[[Draws], Column], bool], ...] = (
    (r"email", _email, False),
    (r"country.*(code|iso)|(code|iso).*country", _of(P.COUNTRY_CODES), False),
    (r"country|nationality", _of(P.COUNTRIES), False),
    (r"^(.*_)?state_code$", _of(P.STATE_CODES), False),
    (r"^state$|^state_|_state$|_state_", _of(P.STATES), False),
    (rf"^(?=.*first)(?=.*({_A_NAME}))", _of(P.FIRST_NAMES), False),
    (rf"^(?=.*(last|sur))(?=.*({_A_NAME}))", _of(P.LAST_NAMES), False),
    (rf"^(?=.*(user|login|handle))(?=.*({_A_NAME}))", _login, False),
    (rf"^(?=.*(company|org|vendor|product))(?=.*({_A_NAME}))", _company, False),
    (_A_NAME, _person, False),
    (r"firstname", _of(P.FIRST_NAMES), False),
    (r"lastname|surname", _of(P.LAST_NAMES), False),
    (r"city|town", _of(P.CITIES), False),
    (r"street|address", _street, False),
    (r"zip|postal", lambda d: d.integer(10_000, 99_999).cast("string"), False),
    (r"company|vendor|employer|organization", _company, False),
    (r"phone|mobile|^tel$", _phone, False),
    (r"^status$|_status$", _of(P.STATUSES), False),
    (r"created|updated|_at|date$|timestamp|_on", _past, False),
    (
        r"amount|price|total|cost|revenue|balance|salary|fee",
        lambda d: _two_decimals(F.greatest(F.lit(0.0), d.normal(250.0, 120.0))),
        True,
    ),
    (r"quantity|qty|count|age", lambda d: d.integer(1, 100), True),
)


def _by_type(name: str, type_: str, d: Draws) -> Column:
    if type_ == "uuid":
        return _uuid(d)
    if _INTEGER.search(type_):
        return d.integer(1, 100_000)
    if _FRACTION.search(type_):
        return _two_decimals(F.lit(1.0) + d.unit() * F.lit(9_999.0))
    if type_ in ("boolean", "bool"):
        return d.integer(0, 1) == 1
    if type_ == "date" or "timestamp" in type_:
        return _past(d)
    return F.concat(F.lit(f"{name}_"), d.integer(1, 9999).cast("string"))


def _uuid(d: Draws) -> Column:
    """UUID-shaped text from a hash of the row id."""
    h = F.md5(F.concat_ws("/", F.lit(f"{d.seed}/{d.place}"), d.row_id.cast("string")).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, start, length) for start, length in cuts])


def value_of(table: str, spec: ColumnSpec, row_id: Column, seed: int, parents: Mapping[str, int]) -> Column:
    """The first rule that applies: foreign key, allowed values, key, name, type."""
    d = Draws(row_id, seed, f"{table}.{spec.name}")
    type_, name = spec.type.lower(), spec.name.lower()
    if spec.is_fk and spec.fk_table in parents:
        return d.wide(1, parents[spec.fk_table])
    if spec.allowed:
        first, rest = spec.allowed[0], spec.allowed[1:]
        return F.when(d.unit() < 0.5, first).otherwise(d.pick(rest, 1)) if rest else F.lit(first)
    if spec.is_pk:
        if type_ == "uuid":
            return _uuid(d)
        return row_id if _INTEGER.search(type_) else F.concat(F.lit(f"{spec.name}_"), row_id.cast("string"))
    is_number = bool(_FRACTION.search(type_)) or type_ in ("int", "integer", "bigint")
    for pattern, make, needs_number in NAME_RULES:
        if re.search(pattern, name) and (is_number or not needs_number):
            return make(d)
    return _by_type(spec.name, type_, d)


def synth_table(
    ids: DataFrame, table: str, specs: Sequence[ColumnSpec], seed: int = 42, parents: Mapping[str, int] | None = None
) -> DataFrame:
    """One generated row per row id; ``parents`` gives the row counts of parents with keys 1..n."""
    row_id = F.col("id").cast("bigint")
    return ids.select(*[value_of(table, s, row_id, seed, parents or {}).alias(s.name) for s in specs])


def synth_fk(child_ids: DataFrame, parent: DataFrame, pk: str, column: str, seed: int = 42) -> DataFrame:
    """Row ids with a foreign key drawn uniformly from existing, arbitrary parent keys.

    Parent keys get dense numbers by a distributed ranking; the drawn numbers
    are then an equi join, evenly spread because the draw is uniform.
    """
    keys = exact_ranks(parent.select(pk).distinct(), [], pk, pk, kinds=["row_number"])
    n = parent.select(F.count_distinct(pk)).scalar()
    drawn = child_ids.select("id", Draws(F.col("id"), seed, column).wide(1, n).alias("row_number"))
    return drawn.join(keys, "row_number").select("id", F.col(pk).alias(column))


def synth_row_budget(catalog: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Rows to generate per table: 50 times 3 for every foreign key, three at most."""
    fks = catalog.groupBy(*within, "table_name").agg(F.count_if("is_fk").alias("foreign_keys"))
    factor = F.pow(F.lit(3.0), F.least(F.col("foreign_keys"), F.lit(3)))
    return fks.withColumn("rows", (F.lit(50) * factor).cast("bigint"))


def synth_check(tables: Mapping[str, DataFrame], specs: Mapping[str, Sequence[ColumnSpec]]) -> DataFrame:
    """Violations per (table, column, check): repeated keys, orphans, NULLs, values outside the domain.

    For a column with allowed values, ``first_share`` is the share of the first.
    One aggregate per table and one join of distinct keys per foreign key.
    """
    none = F.lit(None).cast("double")
    out = []
    for table, df in tables.items():
        aggregates, lines = [], []

        def line(spec, check, value, share=none):
            lines.append(
                F.struct(
                    F.lit(table).alias("table_name"), F.lit(spec.name).alias("column_name"), F.lit(check).alias("check"),
                    value.alias("violations"), share.alias("first_share"),
                )
            )

        for i, s in enumerate(specs[table]):
            if s.is_pk:
                aggregates += [F.count(s.name).alias(f"n{i}"), F.count_distinct(s.name).alias(f"d{i}")]
                line(s, "unique", F.col(f"n{i}") - F.col(f"d{i}"))
            if s.is_pk or not s.nullable:
                aggregates.append(F.count_if(F.col(s.name).isNull()).alias(f"z{i}"))
                line(s, "not_null", F.col(f"z{i}"))
            if s.allowed:
                inside = F.col(s.name).isin(*s.allowed)
                aggregates += [
                    F.count_if(~inside).alias(f"o{i}"),
                    F.count_if(F.col(s.name) == s.allowed[0]).alias(f"f{i}"),
                    F.count(s.name).alias(f"v{i}"),
                ]
                line(s, "domain", F.col(f"o{i}"), ratio(f"f{i}", f"v{i}"))
            if s.is_fk and s.fk_table in tables:
                parent = tables[s.fk_table].select(F.col(s.fk_column).alias("k")).distinct()
                used = df.where(F.col(s.name).isNotNull()).groupBy(F.col(s.name).alias("k")).agg(F.count(F.lit(1)).alias("n"))
                orphans = used.join(parent, "k", "left_anti").agg(total("n").alias("violations"))
                out.append(
                    orphans.select(
                        F.lit(table).alias("table_name"), F.lit(s.name).alias("column_name"),
                        F.lit("foreign_key").alias("check"), "violations", none.alias("first_share"),
                    )
                )
        if lines:
            out.append(df.agg(*aggregates).select(F.inline(F.array(*lines))))
    return reduce(DataFrame.unionByName, out)


def proof_on_synthetic(
    ids: Mapping[str, DataFrame],
    sizes: Mapping[str, int],
    specs: Mapping[str, Sequence[ColumnSpec]],
    fact: str,
    others: Mapping[str, str],
    key: str,
    seed: int = 7,
) -> DataFrame:
    """Generate every table at its size and prove the fan-out on them.

    ``ids`` are the row ids per table (row_ids() at the row budget, or the ids of
    real tables), ``others`` maps child table to its key column, ``key`` is the
    fact's key.
    """
    made = {name: synth_table(df, name, specs[name], seed, sizes) for name, df in ids.items()}
    return fanout_proof(made[fact], key, key, {name: (made[name], column) for name, column in others.items()})
