"""NULL, predicate and table-quality audits on one table: each is a single conditional aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.plans.shapes import ratio, total, unpivot_row


def null_equality_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows each NULL comparison keeps, per column.

    The comparisons are counted, not filtered on: the optimizer folds
    ``WHERE x = NULL`` to an empty relation and would hide the row count.
    """
    null = F.lit(None)
    tests = {
        "eq_null": lambda c: F.coalesce(F.col(c) == null.cast(df.schema[c].dataType), F.lit(False)),
        "ne_null": lambda c: F.coalesce(F.col(c) != null.cast(df.schema[c].dataType), F.lit(False)),
        "is_null": lambda c: F.col(c).isNull(),
        "is_not_null": lambda c: F.col(c).isNotNull(),
    }
    sums = df.agg(
        *[F.count_if(test(c)).alias(f"{i}_{name}") for i, c in enumerate(cols) for name, test in tests.items()]
    )
    return unpivot_row(
        sums, "column_name", {c: {name: F.col(f"{i}_{name}") for name in tests} for i, c in enumerate(cols)}
    )


def contradictory_filter(df: DataFrame, values: Sequence[tuple[str, object]]) -> DataFrame:
    """Equality values AND-ed together, per column: rows per value, under AND, under OR.

    A column with two or more distinct values is a contradiction. Pass only the
    values of one AND branch; OR branches are separate calls.
    """
    per_column: dict[str, list] = {}
    for column, value in values:
        if value not in per_column.setdefault(column, []):
            per_column[column].append(value)
    flat = [(c, v) for c, vs in per_column.items() for v in vs]

    def eq(c, v):
        return F.coalesce(F.col(c) == F.lit(v), F.lit(False))

    sums = df.agg(
        *[F.count_if(eq(c, v)).alias(f"v{i}") for i, (c, v) in enumerate(flat)],
        *[
            F.count_if(reduce(op, [eq(c, v) for v in vs])).alias(f"{name}_{c}")
            for c, vs in per_column.items()
            for name, op in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b))
        ],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(str(v)).alias("value"),
            F.col(f"v{i}").alias("value_rows"),
            F.col(f"and_{c}").alias("and_rows"),
            F.col(f"or_{c}").alias("or_rows"),
            F.lit(len(per_column[c]) > 1).alias("contradictory"),
        )
        for i, (c, v) in enumerate(flat)
    ]
    return sums.select(F.inline(F.array(*rows)))


def avg_null_drift(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """AVG(x), which skips NULLs, against the averages over all rows, per group."""
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(x).isNull()).alias("null_rows"),
            F.sum(x).alias("_s"),
            F.count(x).alias("_n"),
        )
        .select(
            *by,
            "rows",
            "null_rows",
            ratio("_s", "_n").alias("avg_skipping_nulls"),
            ratio("_s", "rows").alias("sum_over_count_star"),
            ratio(F.coalesce(F.col("_s"), F.lit(0)), F.col("rows")).alias("avg_nulls_as_zero"),
        )
        .withColumn("drift", F.col("avg_skipping_nulls") - F.col("avg_nulls_as_zero"))
    )


def count_null_gap(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """COUNT(*), COUNT(col), COUNT(DISTINCT col) and the gap, per column.

    Exact distinct counts need one shuffle of each column's distinct values;
    ``approximate`` replaces it by a fixed-size sketch.
    """
    profile = column_profile(df.select(*cols), approximate)
    return profile.select(
        "column_name",
        F.col("rows").alias("count_star"),
        (F.col("rows") - F.col("nulls")).alias("count_col"),
        F.col("distinct_values").alias("count_distinct"),
        F.col("nulls").alias("gap"),
    )


def integer_division_loss(df: DataFrame, num: str, den: str, by: Sequence[str]) -> DataFrame:
    """Truncating against exact division, on rows and on the group totals."""
    n, d = F.col(num), F.col(den)
    sn, sd = F.col("num_total"), F.col("den_total")
    exact = ratio(n, d)
    truncated = F.expr(f"`{num}` div nullif(`{den}`, 0)")
    grouped = df.groupBy(*by).agg(
        total(n.cast("bigint")).alias("num_total"),
        total(d.cast("bigint")).alias("den_total"),
        F.count_if((exact > 0) & (exact < 1)).alias("rows_lost_to_zero"),
        total(truncated).alias("truncated_row_sum"),
    )
    group_exact = ratio(sn, sd)
    return grouped.select(
        *by,
        "num_total",
        "den_total",
        F.expr("num_total div nullif(den_total, 0)").alias("truncated"),
        group_exact.alias("exact"),
        "truncated_row_sum",
        "rows_lost_to_zero",
        F.coalesce((group_exact > 0) & (group_exact < 1), F.lit(False)).alias("group_lost_to_zero"),
    )


def fd_violation(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Groups in which a selected but ungrouped column has more than one value.

    min <> max decides, so no distinct is needed; a NULL beside a value counts too.
    """
    grouped = df.groupBy(*keys).agg(
        F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(col).alias("filled")
    )
    mixed = (F.col("lo") != F.col("hi")) | ((F.col("filled") > 0) & (F.col("filled") < F.col("n")))
    mixed = F.coalesce(mixed, F.lit(False))
    example = F.min(F.when(mixed, F.struct(*keys, "lo", "hi")))
    return grouped.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(mixed).alias("violating_groups"),
        total(F.when(mixed, F.col("n"))).alias("violating_rows"),
        example.alias("_e"),
    ).select(
        "groups",
        "violating_groups",
        "violating_rows",
        ratio("violating_groups", "groups").alias("violating_share"),
        F.col("_e.lo").alias("example_min"),
        F.col("_e.hi").alias("example_max"),
    )


def having_grain_compare(df: DataFrame, measure: str, threshold, key: str) -> DataFrame:
    """SUM(measure) > threshold read three ways: HAVING over the whole table, per key, and as a row filter."""
    over = F.lit(threshold)
    per_key = df.groupBy(key).agg(
        F.sum(measure).alias("s"), F.count_if(F.col(measure) > over).alias("passing"), F.count(F.lit(1)).alias("n")
    )
    return per_key.agg(
        F.coalesce(F.sum("s") > over, F.lit(False)).alias("whole_table_passes"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("s") > over).alias("groups_passing"),
        total("n").alias("rows"),
        total("passing").alias("rows_passing_as_where"),
    )


def mutation_blast_radius(df: DataFrame, predicate: Column | None, by: Sequence[Column | str]) -> DataFrame:
    """Rows an UPDATE or DELETE would hit, per partition; no predicate hits everything."""
    hit = F.coalesce(predicate, F.lit(False)) if predicate is not None else F.lit(True)
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("rows_hit"))
        .withColumn("share", ratio("rows_hit", "rows"))
        .withColumn("everything", F.col("rows_hit") == F.col("rows"))
    )


def snapshot_loss(before: DataFrame, after: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Keys lost, kept and added between two snapshots; ``after`` is None when the table is gone."""
    flag = F.lit(1)
    if after is None:
        after = before.limit(0)
        missing = True
    else:
        missing = False
    b = before.select(*keys).groupBy(*keys).agg(F.count(flag).alias("b"))
    a = after.select(*keys).groupBy(*keys).agg(F.count(flag).alias("a"))
    sums = b.join(a, list(keys), "full_outer").agg(
        total("b").alias("rows_before"),
        total("a").alias("rows_after"),
        total(F.when(F.col("a").isNull(), F.col("b"))).alias("lost_rows"),
        total(F.when(F.col("a").isNotNull(), F.col("b"))).alias("kept_rows"),
        total(F.when(F.col("b").isNull(), F.col("a"))).alias("added_rows"),
    )
    return sums.withColumn("all_rows_gone", (F.col("rows_before") > 0) & (F.col("kept_rows") == 0)).withColumn(
        "table_missing", F.lit(missing)
    )


# From this many rows a table counts as large; names of event-like tables.
LARGE_TABLE_ROWS = 1_000_000
WIDTHS = {
    "boolean": 1, "byte": 1, "short": 2, "integer": 4, "date": 4, "float": 4, "long": 8, "double": 8, "timestamp": 8,
    "timestamp_ntz": 8,
}
EVENT_TABLES = ("transactions", "events", "logs", "audit", "pageviews", "clicks")


def _bytes(df: DataFrame, column: str) -> Column:
    width = WIDTHS.get(df.schema[column].dataType.typeName())
    value = F.col(column)
    return F.octet_length(value.cast("string")).cast("bigint") if width is None else F.when(value.isNotNull(), F.lit(width).cast("bigint"))


def column_footprint(df: DataFrame, used: Sequence[str], table_name: str = "") -> DataFrame:
    """Bytes per column, its share, its rank, and what SELECT * reads beyond the ``used`` columns.

    Text counts by its bytes, numbers and times by the width of their type, NULL not at all.
    """
    names = df.columns
    size = [_bytes(df, c) for c in names]
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), *[total(s).alias(f"b_{i}") for i, s in enumerate(size)]
    )
    cells = [F.col(f"b_{i}") for i in range(len(names))]
    whole = reduce(lambda a, b: a + b, cells)
    needed = reduce(lambda a, b: a + b, [F.col(f"b_{names.index(u)}") for u in used], F.lit(0))
    event_like = table_name.lower() in EVENT_TABLES

    def rank(i: int) -> Column:
        ahead = [
            ((cells[j] > cells[i]) | ((cells[j] == cells[i]) & F.lit(names[j] < names[i]))).cast("int")
            for j in range(len(names))
            if j != i
        ]
        return reduce(lambda a, b: a + b, ahead, F.lit(1))

    return unpivot_row(
        sums,
        "column_name",
        {
            c: {
                "bytes": cells[i],
                "share": ratio(cells[i], whole),
                "size_rank": rank(i),
                "is_used": F.lit(c in used),
                "star_over_used": ratio(whole, needed),
                "expensive": (F.col("n") > LARGE_TABLE_ROWS) | F.lit(event_like),
            }
            for i, c in enumerate(names)
        },
    )


def domain_violation(df: DataFrame, col: str, allowed: Sequence | DataFrame) -> DataFrame:
    """Rows per value outside an allowed list; the list may itself be a table of one column.

    NULL satisfies a CHECK constraint and is not reported.
    """
    per_value = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    if isinstance(allowed, DataFrame):
        domain = allowed.select(F.col(allowed.columns[0]).alias("value"))
        return per_value.join(domain, "value", "left_anti")
    return per_value.where(~F.col("value").isin(list(allowed)))


def _profile_line(name: str) -> list[Column]:
    known = F.col("rows") - F.col("nulls")
    return [
        F.lit(name).alias("column_name"),
        F.col("rows"),
        F.col("nulls"),
        F.col("distinct_values"),
        F.col("min_value"),
        F.col("max_value"),
        (F.col("nulls") > 0).alias("observed_nullable"),
        ((F.col("rows") > 0) & (known == F.col("rows")) & (F.col("distinct_values") == F.col("rows"))).alias("observed_unique"),
    ]


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Observed nullability, uniqueness and range of every column: the data twin of a declared schema.

    Exact: each column is grouped by its own values, so a columnar source reads
    every column once and no row is multiplied, as several COUNT(DISTINCT) in one
    aggregate would do. ``approximate`` keeps a fixed-size sketch instead of the values.
    """
    if approximate:
        # One aggregate over all columns, turned into one line each.
        sums = {
            f"{name}_{i}": value
            for i, c in enumerate(df.columns)
            for name, value in (
                ("nulls", F.count(F.lit(1)) - F.count(F.col(c))),
                ("distinct", F.approx_count_distinct(F.col(c))),
                ("min", F.min(F.col(c)).cast("string")),
                ("max", F.max(F.col(c)).cast("string")),
            )
        }
        one = df.agg(F.count(F.lit(1)).alias("rows"), *(value.alias(name) for name, value in sums.items()))
        lines = {}
        for i, c in enumerate(df.columns):
            known = {"rows": F.col("rows"), "nulls": F.col(f"nulls_{i}"), "distinct_values": F.col(f"distinct_{i}")}
            judged = {
                "observed_nullable": F.col(f"nulls_{i}") > 0,
                "observed_unique": (F.col("rows") > 0) & (F.col(f"nulls_{i}") == 0) & (F.col(f"distinct_{i}") == F.col("rows")),
            }
            lines[c] = known | {"min_value": F.col(f"min_{i}"), "max_value": F.col(f"max_{i}")} | judged
        return unpivot_row(one, "column_name", lines)
    stats = [
        df.groupBy(F.col(c).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            total("n").alias("rows"),
            total(F.when(F.col("v").isNull(), F.col("n"))).alias("nulls"),
            F.count("v").alias("distinct_values"),
            F.min("v").cast("string").alias("min_value"),
            F.max("v").cast("string").alias("max_value"),
        )
        for c in df.columns
    ]
    return reduce(DataFrame.unionByName, [s.select(*_profile_line(c)) for s, c in zip(stats, df.columns)])


def infer_foreign_key(child: DataFrame, col: str, parent: DataFrame, pk: str) -> DataFrame:
    """How much of a child column exists in a parent key: values, rows, orphans, NULLs."""
    values = child.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(pk).alias("v"), F.lit(1).alias("hit")).where("v IS NOT NULL").distinct()
    is_value = F.col("v").isNotNull()
    orphan = is_value & F.col("hit").isNull()
    return (
        values.join(keys, "v", "left")
        .agg(
            F.count("v").alias("child_values"),
            F.count("hit").alias("matched_values"),
            F.count_if(orphan).alias("orphan_values"),
            total(F.when(orphan, F.col("n"))).alias("orphan_rows"),
            total(F.when(~is_value, F.col("n"))).alias("null_rows"),
        )
        .withColumn("coverage", ratio("matched_values", "child_values"))
        .withColumn("child_nullable", F.col("null_rows") > 0)
        .withColumn("is_foreign_key", (F.col("child_values") > 0) & (F.col("orphan_values") == 0))
    )
