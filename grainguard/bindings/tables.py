"""Single-table audits: NULLs, predicates, time, ranking, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainguard.bindings.joins import _dbl, _money, _round
from grainguard.bindings.registry import bind
from grainguard.operators import nulls as N
from grainguard.operators import times as T
from grainguard.operators import windows as W
from grainguard.sources.tables import AS_OF

# ---------------------------------------------------------------- NULLs and predicates


@bind(
    "null_equality_audit",
    " UNION ALL ".join(
        f"""
    SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} = NULL) AS eq_null,
           COUNT(*) FILTER (WHERE {c} <> NULL) AS ne_null, COUNT(*) FILTER (WHERE {c} IS NULL) AS is_null,
           COUNT(*) FILTER (WHERE {c} IS NOT NULL) AS is_not_null FROM orders_n"""
        for c in ("o_custkey", "amount")
    ),
)
def _(t):
    return N.null_equality_audit(t.orders_n, ["o_custkey", "amount"])


@bind(
    "contradictory_filter",
    """
    WITH s AS (SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o,
                      COUNT(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderstatus = 'O') AS a,
                      COUNT(*) FILTER (WHERE o_orderstatus = 'F' OR o_orderstatus = 'O') AS r,
                      COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS l FROM orders)
    SELECT 'o_orderstatus' AS column_name, 'F' AS value, f AS value_rows, a AS and_rows, r AS or_rows,
           TRUE AS contradictory FROM s
    UNION ALL SELECT 'o_orderstatus', 'O', o, a, r, TRUE FROM s
    UNION ALL SELECT 'o_orderpriority', '5-LOW', l, l, l, FALSE FROM s""",
)
def _(t):
    return N.contradictory_filter(
        t.orders,
        [("o_orderstatus", "F"), ("o_orderstatus", "O"), ("o_orderstatus", "F"), ("o_orderpriority", "5-LOW")],
    )


@bind(
    "avg_null_drift",
    """
    WITH s AS (SELECT o_orderstatus, COUNT(*) AS n, COUNT(*) - COUNT(amount) AS nulls,
                      CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS a,
                      CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS z FROM orders_n GROUP BY 1)
    SELECT o_orderstatus, n AS "rows", nulls AS null_rows, ROUND(a, 6) AS avg_skipping_nulls,
           ROUND(z, 6) AS sum_over_count_star, ROUND(z, 6) AS avg_nulls_as_zero, ROUND(a - z, 6) AS drift FROM s""",
)
def _(t):
    return _round(
        N.avg_null_drift(t.orders_n, "amount", ["o_orderstatus"]),
        "avg_skipping_nulls", "sum_over_count_star", "avg_nulls_as_zero", "drift",
    )


@bind(
    "count_null_gap",
    " UNION ALL ".join(
        f"""
    SELECT '{c}' AS column_name, COUNT(*) AS count_star, COUNT({c}) AS count_col,
           COUNT(DISTINCT {c}) AS count_distinct, COUNT(*) - COUNT({c}) AS gap FROM orders_n"""
        for c in ("o_custkey", "amount")
    ),
)
def _(t):
    return N.count_null_gap(t.orders_n, ["o_custkey", "amount"])


@bind(
    "integer_division_loss",
    """
    WITH s AS (SELECT o_orderstatus, CAST(SUM(done) AS BIGINT) AS num_total, CAST(SUM(planned) AS BIGINT) AS den_total,
                      CAST(SUM(done // planned) AS BIGINT) AS truncated_row_sum,
                      COUNT(*) FILTER (WHERE done > 0 AND done < planned) AS rows_lost_to_zero
               FROM orders_n GROUP BY 1)
    SELECT o_orderstatus, num_total, den_total, num_total // den_total AS truncated,
           ROUND(num_total / den_total, 6) AS exact, truncated_row_sum, rows_lost_to_zero,
           num_total > 0 AND num_total < den_total AS group_lost_to_zero FROM s""",
)
def _(t):
    return _round(N.integer_division_loss(t.orders_n, "done", "planned", ["o_orderstatus"]), "exact")


@bind(
    "fd_violation",
    """
    WITH g AS (SELECT o_custkey, MIN(o_orderpriority) AS lo, MAX(o_orderpriority) AS hi, COUNT(*) AS n
               FROM orders GROUP BY 1)
    SELECT COUNT(*) AS groups, COUNT(*) FILTER (WHERE lo <> hi) AS violating_groups,
           CAST(SUM(n) FILTER (WHERE lo <> hi) AS BIGINT) AS violating_rows,
           ROUND(COUNT(*) FILTER (WHERE lo <> hi) / COUNT(*), 6) AS violating_share,
           ARG_MIN(lo, o_custkey) FILTER (WHERE lo <> hi) AS example_min,
           ARG_MIN(hi, o_custkey) FILTER (WHERE lo <> hi) AS example_max FROM g""",
)
def _(t):
    return _round(N.fd_violation(t.orders, ["o_custkey"], "o_orderpriority"), "violating_share")


@bind(
    "having_grain_compare",
    """
    WITH o AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS m FROM orders),
         g AS (SELECT o_custkey, SUM(m) AS s FROM o GROUP BY 1)
    SELECT (SELECT SUM(m) > 1000000 FROM o) AS whole_table_passes, COUNT(*) AS groups,
           COUNT(*) FILTER (WHERE s > 1000000) AS groups_passing, (SELECT COUNT(*) FROM o) AS "rows",
           (SELECT COUNT(*) FROM o WHERE m > 1000000) AS rows_passing_as_where FROM g""",
)
def _(t):
    return N.having_grain_compare(_money(t.orders, "o_totalprice"), "o_totalprice", 1_000_000, "o_custkey")


@bind(
    "mutation_blast_radius",
    """
    SELECT CAST(year(o_orderdate) AS INT) AS order_year, COUNT(*) AS "rows",
           COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS rows_hit,
           ROUND(COUNT(*) FILTER (WHERE o_orderstatus = 'F') / COUNT(*), 6) AS share,
           COUNT(*) FILTER (WHERE o_orderstatus = 'F') = COUNT(*) AS everything FROM orders GROUP BY 1""",
)
def _(t):
    by_year = [F.year("o_orderdate").alias("order_year")]
    return _round(N.mutation_blast_radius(t.orders, F.col("o_orderstatus") == "F", by_year), "share")


@bind(
    "mutation_without_where",
    """
    SELECT CAST(year(o_orderdate) AS INT) AS order_year, COUNT(*) AS "rows", COUNT(*) AS rows_hit,
           CAST(1 AS DOUBLE) AS share, TRUE AS everything FROM orders GROUP BY 1""",
)
def _(t):
    return N.mutation_blast_radius(t.orders, None, [F.year("o_orderdate").alias("order_year")])


_AFTER = """
    SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT -o_orderkey - 1 AS o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'"""


@bind(
    "snapshot_loss",
    f"""
    WITH a AS ({_AFTER})
    SELECT (SELECT COUNT(*) FROM orders) AS rows_before, (SELECT COUNT(*) FROM a) AS rows_after,
           (SELECT COUNT(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)) AS lost_rows,
           (SELECT COUNT(*) FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM a)) AS kept_rows,
           (SELECT COUNT(*) FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS added_rows,
           FALSE AS all_rows_gone, FALSE AS table_missing""",
)
def _(t):
    kept = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey")
    added = t.orders.where("o_orderpriority = '5-LOW'").select((-F.col("o_orderkey") - 1).alias("o_orderkey"))
    return N.snapshot_loss(t.orders, kept.unionByName(added), ["o_orderkey"])


@bind(
    "snapshot_dropped_table",
    """
    SELECT COUNT(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after, COUNT(*) AS lost_rows,
           CAST(0 AS BIGINT) AS kept_rows, CAST(0 AS BIGINT) AS added_rows, TRUE AS all_rows_gone,
           TRUE AS table_missing FROM orders""",
)
def _(t):
    return N.snapshot_loss(t.orders, None, ["o_orderkey"])


# All columns of the table; what one value takes.
_SIZED = {
    "l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8, "l_extendedprice": 8, "l_discount": 8,
    "l_tax": 8, "l_returnflag": None, "l_linestatus": None, "l_shipdate": 8,
}


@bind(
    "column_footprint",
    f"""
    WITH c AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({f'{w} * COUNT({c})' if w else f'SUM(strlen({c}))'} AS BIGINT) AS bytes, COUNT(*) AS n FROM lineitem"
        for c, w in _SIZED.items())}),
         s AS (SELECT SUM(bytes) AS whole,
                      SUM(bytes) FILTER (WHERE column_name IN ('l_orderkey', 'l_partkey')) AS needed FROM c)
    SELECT column_name, bytes, ROUND(bytes / whole, 6) AS share,
           CAST(RANK() OVER (ORDER BY bytes DESC, column_name) AS INT) AS size_rank,
           column_name IN ('l_orderkey', 'l_partkey') AS is_used, ROUND(whole / needed, 6) AS star_over_used,
           n > {N.LARGE_TABLE_ROWS} AS expensive
    FROM c, s""",
)
def _(t):
    df = N.column_footprint(t.lineitem, ["l_orderkey", "l_partkey"], "lineitem")
    return _round(df, "share", "star_over_used")


@bind(
    "domain_violation",
    """
    SELECT o_orderstatus AS value, COUNT(*) AS "rows" FROM orders
    WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1""",
)
def _(t):
    return N.domain_violation(t.orders, "o_orderstatus", ["F", "O"])


@bind(
    "domain_violation_table",
    """
    SELECT o_custkey AS value, COUNT(*) AS "rows" FROM orders_n
    WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
)
def _(t):
    return N.domain_violation(t.orders_n, "o_custkey", t.customer.select("c_custkey"))


_PROFILED = ["o_orderkey", "o_custkey", "amount", "done", "planned", "o_orderstatus", "o_orderdate"]


@bind(
    "column_profile",
    " UNION ALL ".join(
        f"""
    SELECT '{c}' AS column_name, COUNT(*) AS "rows", COUNT(*) - COUNT({c}) AS nulls,
           COUNT(DISTINCT {c}) AS distinct_values, CAST(MIN({c}) AS VARCHAR) AS min_value,
           CAST(MAX({c}) AS VARCHAR) AS max_value, COUNT(*) > COUNT({c}) AS observed_nullable,
           COUNT(DISTINCT {c}) = COUNT(*) AS observed_unique FROM orders_n"""
        for c in _PROFILED
    ),
)
def _(t):
    return N.column_profile(t.orders_n.select(*_PROFILED))


_FK = """
    WITH v AS (SELECT {col} AS v, COUNT(*) AS n FROM {child} GROUP BY 1),
         j AS (SELECT v.*, p.{pk} AS hit FROM v LEFT JOIN (SELECT DISTINCT {pk} FROM {parent}) p ON p.{pk} = v.v)
    SELECT COUNT(v) AS child_values, COUNT(hit) AS matched_values, COUNT(v) - COUNT(hit) AS orphan_values,
           CAST(COALESCE(SUM(n) FILTER (WHERE v IS NOT NULL AND hit IS NULL), 0) AS BIGINT) AS orphan_rows,
           CAST(COALESCE(SUM(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS null_rows,
           ROUND(COUNT(hit) / COUNT(v), 6) AS coverage, null_rows > 0 AS child_nullable,
           COUNT(v) = COUNT(hit) AS is_foreign_key FROM j"""


@bind("infer_foreign_key", _FK.format(col="o_custkey", child="orders_n", pk="c_custkey", parent="customer"))
def _(t):
    return _round(N.infer_foreign_key(t.orders_n, "o_custkey", t.customer, "c_custkey"), "coverage")


@bind("infer_foreign_key_lineitem", _FK.format(col="l_orderkey", child="lineitem", pk="o_orderkey", parent="orders"))
def _(t):
    return _round(N.infer_foreign_key(t.lineitem, "l_orderkey", t.orders, "o_orderkey"), "coverage")


# ---------------------------------------------------------------- time


@bind(
    "missing_time_filter",
    f"""
    WITH s AS (SELECT COUNT(*) AS all_rows,
                      COUNT(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAYS
                                         AND o_orderdate <= TIMESTAMP '{AS_OF}') AS window_rows,
                      SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS a,
                      SUM(CAST(o_totalprice AS DECIMAL(18,2)))
                        FILTER (WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAYS
                                  AND o_orderdate <= TIMESTAMP '{AS_OF}') AS w
               FROM orders WHERE o_orderstatus = 'F')
    SELECT all_rows, window_rows, CAST(a AS DOUBLE) AS all_sum, CAST(COALESCE(w, 0) AS DOUBLE) AS window_sum,
           ROUND(1 - window_rows / all_rows, 6) AS share_outside,
           ROUND(1 - CAST(COALESCE(w, 0) AS DOUBLE) / CAST(a AS DOUBLE), 6) AS sum_share_outside FROM s""",
)
def _(t):
    df = T.missing_time_filter(
        _money(t.orders, "o_totalprice"), F.col("o_orderstatus") == "F", "o_orderdate", "o_totalprice", 365, AS_OF
    )
    return _round(_dbl(df, "all_sum", "window_sum"), "share_outside", "sum_share_outside")


@bind(
    "bare_scan_growth",
    f"""
    WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n,
                      COUNT(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS
                                         AND o_orderdate <= TIMESTAMP '{AS_OF}') AS r FROM orders GROUP BY 1)
    SELECT month, n AS "rows", CAST(SUM(n) OVER (ORDER BY month) AS BIGINT) AS cumulative_rows,
           ROUND(SUM(r) OVER () / SUM(n) OVER (), 6) AS filtered_share FROM m""",
)
def _(t):
    df = T.bare_scan_growth(t.orders, "o_orderdate", AS_OF)
    return _round(df, "filtered_share").withColumn("month", F.date_format("month", "yyyy-MM"))


@bind(
    "timezone_shift",
    " UNION ALL ".join(
        f"""
    SELECT {h} AS offset_hours, COUNT(ts) AS "rows",
           COUNT(*) FILTER (WHERE CAST(ts + INTERVAL ({h}) HOURS AS DATE) <> CAST(ts AS DATE)) AS day_changed,
           COUNT(*) FILTER (WHERE (ts + INTERVAL ({h}) HOURS >= TIMESTAMP '2024-01-02 00:00:00')
                               <> (ts >= TIMESTAMP '2024-01-02 00:00:00')) AS cutoff_changed FROM events"""
        for h in (-5, 9)
    ),
)
def _(t):
    return T.timezone_shift(t.events, "ts", [-5, 9], "2024-01-02 00:00:00")


@bind(
    "month_rollup",
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS "rows",
           strftime(MIN(o_orderdate), '%b %Y') AS label FROM orders GROUP BY 1, 2""",
)
def _(t):
    df = T.month_rollup(_money(t.orders, "o_totalprice"), "o_orderdate", "o_totalprice", ["o_orderstatus"])
    return _dbl(df, "revenue").withColumn("month", F.date_format("month", "yyyy-MM"))


# ---------------------------------------------------------------- ranking and paging


@bind(
    "rank_tie_audit",
    """
    WITH s AS (SELECT o_custkey, o_orderdate, COUNT(*) AS n FROM orders GROUP BY 1, 2),
         p AS (SELECT o_custkey, SUM(n) AS n, COUNT(*) FILTER (WHERE n > 1) AS g,
                      COALESCE(SUM(n) FILTER (WHERE n > 1), 0) AS tied, MAX(n) AS big FROM s GROUP BY 1)
    SELECT COUNT(*) AS partitions, CAST(SUM(n) AS BIGINT) AS "rows", CAST(SUM(g) AS BIGINT) AS tie_groups,
           CAST(SUM(tied) AS BIGINT) AS tied_rows, COUNT(*) FILTER (WHERE g > 0) AS partitions_affected,
           MAX(big) AS largest_tie FROM p""",
)
def _(t):
    return W.rank_tie_audit(t.orders, ["o_custkey"], ["o_orderdate"])


def _ranks(part):
    over = f"PARTITION BY {part} ORDER BY o_orderdate"
    return f"""
    SELECT o_orderkey, {part}, o_orderdate, row_number() OVER ({over}, o_orderkey) AS row_number,
           rank() OVER ({over}) AS rank, dense_rank() OVER ({over}) AS dense_rank FROM orders"""


@bind("deterministic_rank", _ranks("o_custkey"))
def _(t):
    df = W.deterministic_rank(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey"
    )
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("row_number", "rank", "dense_rank")})


@bind("deterministic_rank_hot_partition", _ranks("o_orderstatus"))
def _(t):
    df = W.deterministic_rank(
        t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus"], "o_orderdate", "o_orderkey"
    )
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("row_number", "rank", "dense_rank")})


@bind(
    "unordered_window_audit",
    """
    WITH s AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1)
    SELECT COUNT(*) AS partitions, COUNT(*) FILTER (WHERE n > 1) AS partitions_at_risk,
           CAST(SUM(n) FILTER (WHERE n > 1) AS BIGINT) AS rows_at_risk,
           ROUND(SUM(n) FILTER (WHERE n > 1) / SUM(n), 6) AS share_at_risk FROM s""",
)
def _(t):
    return _round(W.unordered_window_audit(t.orders, ["o_custkey"]), "share_at_risk")


@bind(
    "qualify_latest",
    """
    SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(t):
    cols = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return W.qualify_latest(cols, ["o_custkey"], "o_orderdate", "o_orderkey")


@bind(
    "page",
    """
    SELECT o_orderkey, o_custkey, o_orderdate FROM orders
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""",
)
def _(t):
    return W.page(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 40, 20
    )


@bind(
    "flatten_json",
    """
    SELECT event_id, k.key, CAST(json_extract(props, '$.' || k.key) AS BIGINT) AS value
    FROM events, (SELECT UNNEST(json_keys(props)) AS key, event_id AS id FROM events) k WHERE k.id = event_id""",
)
def _(t):
    return W.flatten_json(t.events.select("event_id", "props"), "props", "bigint")
