"""Catalog rows from warehouses to one row per table column."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Long type spellings and their short forms; anything else passes through in lower case.
TYPE_NAMES = {
    "character varying": "varchar",
    "character": "char",
    "integer": "int",
    "bigint": "bigint",
    "smallint": "smallint",
    "boolean": "boolean",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz",
    "double precision": "double",
    "numeric": "numeric",
    "text": "text",
    "uuid": "uuid",
    "date": "date",
    "json": "json",
    "jsonb": "jsonb",
}


def short_type(column: str) -> Column:
    text = F.lower(F.trim(F.col(column)))
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(TYPE_NAMES.items())])
    return F.coalesce(F.try_element_at(names, text), text)


def _named() -> Column:
    return (F.coalesce("table_name", F.lit("")) != "") & (F.coalesce("column_name", F.lit("")) != "")


def catalog_fold(rows: DataFrame, within: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """One row per (table, column) from one row per (table, column, constraint).

    Key flags are OR-ed, type and nullability come from the first row in
    ``order``, the foreign-key target from the last foreign-key row that has one.

    Few rows share a key, so combining them where they are read saves nothing and holds, sorted, all that one task reads.
    They are dealt out by key first.
    """
    fk = F.col("constraint_type") == "FOREIGN KEY"

    def last_target(column: str) -> Column:
        usable = fk & (F.coalesce(F.col(column), F.lit("")) != "")
        return F.max_by(F.when(usable, F.col(column)), F.when(usable, F.col(order)))

    return (
        rows.where(_named())
        .repartition(*within, "table_name", "column_name")
        .groupBy(*within, "table_name", "column_name")
        .agg(
            F.min_by(short_type("data_type"), order).alias("type"),
            F.min_by(F.upper("is_nullable") == "YES", order).alias("nullable"),
            F.coalesce(F.bool_or(F.col("constraint_type") == "PRIMARY KEY"), F.lit(False)).alias("is_pk"),
            F.coalesce(F.bool_or(fk), F.lit(False)).alias("is_fk"),
            last_target("foreign_table_name").alias("fk_table"),
            last_target("foreign_column_name").alias("fk_column"),
            F.min(order).alias("ord"),
        )
    )


FLAT_COLUMNS = ("table_name", "column_name", "data_type", "is_nullable")


def catalog_flat(*catalogs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Catalogs without constraints, some with upper-case headers, in one shape; no key is known."""
    out = None
    for df in catalogs:
        lower = df.withColumnsRenamed({c: c.lower() for c in df.columns})
        part = lower.where(_named()).select(
            *keep,
            "table_name",
            "column_name",
            short_type("data_type").alias("type"),
            (F.upper("is_nullable") == "YES").alias("nullable"),
            F.lit(False).alias("is_pk"),
            F.lit(False).alias("is_fk"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def catalog_rows_from_tables(
    tables: DataFrame,
    columns: DataFrame,
    key_usage: DataFrame,
    constraints: DataFrame,
    usage: DataFrame,
    schema_name: str,
    within: Sequence[str] = (),
) -> DataFrame:
    """The catalog query as joins on information-schema tables: base tables of one schema, their columns and keys.

    ``within`` names extra key columns, such as the database an export came from. No side is known to be small: where the
    tables are made from fewer rows, the engine's estimate of their size is too low by as much, so they are merged and not
    broadcast through the driver.
    """
    own = list(within)
    base = tables.where((F.col("table_schema") == schema_name) & (F.col("table_type") == "BASE TABLE"))
    wanted = columns.where(F.col("table_schema") == schema_name).drop("table_schema")
    targets = usage.select(
        *own,
        "constraint_name",
        F.col("table_name").alias("foreign_table_name"),
        F.col("column_name").alias("foreign_column_name"),
    )
    is_fk = F.col("constraint_type") == "FOREIGN KEY"
    keys = (
        key_usage.join(constraints.select(*own, "constraint_name", "constraint_type").hint("merge"), [*own, "constraint_name"])
        .join(targets.hint("merge"), [*own, "constraint_name"], "left")
        .select(
            *own, "table_name", "column_name", "constraint_type",
            F.when(is_fk, F.col("foreign_table_name")).alias("foreign_table_name"),
            F.when(is_fk, F.col("foreign_column_name")).alias("foreign_column_name"),
        )
    )
    return (
        base.select(*own, "table_name")
        .join(wanted.hint("merge"), [*own, "table_name"])
        .join(keys.hint("merge"), [*own, "table_name", "column_name"], "left")
    )


def catalog_ingest(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Catalog rows over JDBC from a live database; needs that database's driver on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
