"""Reference logs against a catalog: unknown tables, columns, qualifiers, ambiguous names.

``refs`` has one row per column a query touched (query_id, table_name,
column_name, clause, qualified); ``catalog`` one row per (table_name,
column_name) with ``ord``. Logs repeat the same few names endlessly, so names
are reduced to distinct ones, resolved, and only then joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainguard.functions.names import closest, nearest_name
from grainguard.plans.shapes import array_shards, is_small
from grainguard.session import cut


def _named_columns(catalog: DataFrame) -> DataFrame:
    return catalog.where((F.col("table_name") != "") & (F.col("column_name") != ""))


def _distinct_hits(log: DataFrame, bad: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct log rows that carry one of the ``bad`` names, with the columns of ``bad``.

    As long as the bad names are few, they filter the log where it is read.
    Otherwise the log is made distinct first, so that a name with a third of all
    references is not joined in one task.
    """
    if is_small(bad):
        return log.join(F.broadcast(bad), list(names)).distinct()
    return log.distinct().join(bad, list(names))


def unresolved_tables(refs: DataFrame, catalog: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Tables neither in the catalog nor local to the query, once per (query, name), with the nearest name.

    ``local`` lists (query_id, table_name) of names the query defines itself.
    """
    known = _named_columns(catalog)
    names = refs.select("table_name").where("table_name IS NOT NULL").distinct()
    unknown = names.join(known.select("table_name").distinct(), "table_name", "left_anti")
    candidates = known.select(F.col("table_name").alias("candidate"), "ord")
    hints = nearest_name(unknown, candidates, "table_name", "candidate", "ord").withColumnRenamed("nearest", "suggestion")
    bad = cut(unknown.join(hints, "table_name", "left"))
    found = _distinct_hits(refs.select("query_id", "table_name"), bad, ["table_name"])
    if local is not None:
        found = found.join(local.select("query_id", "table_name").distinct(), ["query_id", "table_name"], "left_anti")
    return found.select("query_id", "table_name", "suggestion")


def unresolved_columns(refs: DataFrame, catalog: DataFrame, select_aliases: DataFrame | None = None) -> DataFrame:
    """Columns that do not exist where the query looks for them.

    Qualified: not on its table; unknown tables are another audit's job. Bare: on
    none of the query's known tables; left out if it is a select alias or no
    table of the query is known. ``table_name`` is NULL for bare columns of a
    query with several known tables.
    """
    columns = _named_columns(catalog).select("table_name", "column_name", "ord")
    tables = columns.select("table_name").distinct()
    owned = columns.select("table_name", "column_name").distinct()
    per_table = columns.select("table_name", F.col("column_name").alias("candidate"), "ord")

    qualified = refs.where("qualified AND column_name IS NOT NULL").select("query_id", "table_name", "column_name")
    pairs = (
        qualified.select("table_name", "column_name")
        .distinct()
        .join(tables, "table_name", "left_semi")
        .join(owned, ["table_name", "column_name"], "left_anti")
    )
    hints = nearest_name(pairs, per_table, "column_name", "candidate", "ord", within=["table_name"])
    bad = cut(pairs.join(hints, ["table_name", "column_name"], "left"))
    qualified_out = _distinct_hits(qualified, bad, ["table_name", "column_name"]).select(
        "query_id", "table_name", "column_name", F.lit(True).alias("qualified"), F.col("nearest").alias("suggestion")
    )

    # Known tables per query, as a sorted array: at most as long as the catalog has tables.
    in_scope = refs.select("query_id", "table_name").distinct().join(tables, "table_name", "left_semi")
    scopes = in_scope.groupBy("query_id").agg(F.sort_array(F.collect_set("table_name")).alias("_tables"))
    bare = (
        refs.where("NOT qualified AND column_name IS NOT NULL").select("query_id", "column_name").distinct()
    )
    if select_aliases is not None:
        bare = bare.join(
            select_aliases.select("query_id", F.col("alias").alias("column_name")).distinct(),
            ["query_id", "column_name"],
            "left_anti",
        )
    # (table set, column) combinations are few however long the log is: resolve those.
    asked = bare.join(scopes, "query_id")
    combos = asked.select("_tables", "column_name").distinct()
    per_combo = combos.select("_tables", "column_name", F.explode("_tables").alias("table_name"))
    found = per_combo.join(owned, ["table_name", "column_name"], "left_semi").select("_tables", "column_name").distinct()
    missing = per_combo.join(found, ["_tables", "column_name"], "left_anti")
    best = _nearest_over_tables(missing, per_table)
    bare_out = asked.join(best, ["_tables", "column_name"]).select(
        "query_id",
        F.when(F.size("_tables") == 1, F.col("_tables")[0]).alias("table_name"),
        "column_name",
        F.lit(False).alias("qualified"),
        "suggestion",
    )
    return qualified_out.unionByName(bare_out)


def _nearest_over_tables(missing: DataFrame, per_table: DataFrame) -> DataFrame:
    """Nearest column over all tables of a table set; table by table, first table wins ties as in catalog order."""
    shards = array_shards(
        per_table.groupBy("table_name", "candidate").agg(F.min("ord").alias("ord")),
        ["table_name"],
        F.struct("ord", "candidate"),
        "_candidates",
    )
    best = (
        missing.join(shards, "table_name")
        .select("_tables", "column_name", closest(F.col("column_name"), F.col("_candidates")).alias("_best"))
        .groupBy("_tables", "column_name")
        .agg(F.min("_best").alias("_best"))
    )
    longer = F.greatest(F.length("column_name"), F.length("_best.candidate")).cast("double")
    near = F.col("_best.d") <= F.greatest(F.lit(3), F.ceil(longer * F.lit(0.4)))
    return best.select("_tables", "column_name", F.when(near, F.col("_best.candidate")).alias("suggestion"))


def unknown_qualifiers(refs: DataFrame, scope: DataFrame, max_distance: int = 2) -> DataFrame:
    """Qualifiers that are neither table nor alias in their query, with the nearest alias within two edits.

    Queries without any alias in scope are not judged; a NULL alias is none. A qualifier meets its query's
    aliases as one array, split when a query has very many.
    """
    aliases = scope.where(F.col("alias").isNotNull()).select("query_id", "alias").distinct()
    used = (
        refs.where("qualified AND table_name IS NOT NULL")
        .select("query_id", F.col("table_name").alias("qualifier"))
        .distinct()
    )
    shards = array_shards(
        aliases, ["query_id"], F.struct(F.col("alias").alias("ord"), F.col("alias").alias("candidate")), "_candidates"
    )
    unknown = used.join(aliases.withColumnRenamed("alias", "qualifier"), ["query_id", "qualifier"], "left_anti")
    best = (
        unknown.join(shards, "query_id")
        .select("query_id", "qualifier", closest(F.col("qualifier"), F.col("_candidates")).alias("_best"))
        .groupBy("query_id", "qualifier")
        .agg(F.min("_best").alias("_best"))
    )
    return best.select(
        "query_id", "qualifier", F.when(F.col("_best.d") <= max_distance, F.col("_best.candidate")).alias("suggestion")
    )


def ambiguous_columns(refs: DataFrame, catalog: DataFrame, select_aliases: DataFrame | None = None) -> DataFrame:
    """Bare columns owned by two or more known tables of their query.

    Each known table of a query is widened to its catalog columns and the bare
    columns are looked up there, so no query pairs its tables with its columns.
    """
    owned = _named_columns(catalog).select("table_name", "column_name").distinct()
    in_scope = refs.select("query_id", "table_name").distinct()
    visible = in_scope.join(owned, "table_name").select("query_id", "column_name", "table_name")
    bare = refs.where("NOT qualified").select("query_id", "column_name").distinct()
    if select_aliases is not None:
        bare = bare.join(
            select_aliases.select("query_id", F.col("alias").alias("column_name")).distinct(),
            ["query_id", "column_name"],
            "left_anti",
        )
    return (
        visible.join(bare, ["query_id", "column_name"], "left_semi")
        .groupBy("query_id", "column_name")
        .agg(F.sort_array(F.collect_set("table_name")).alias("owners"))
        .where(F.size("owners") >= 2)
    )
