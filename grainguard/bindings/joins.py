"""Join audits on customer, orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainguard.bindings.registry import bind
from grainguard.operators import joins as J
from grainguard.operators.jointrees import Joined, join_tree_proof


def _money(df, column):
    return df.withColumn(column, F.col(column).cast("decimal(18,2)"))


def _big(df, *columns):
    """Fit the wide totals back into BIGINT for the comparison with the oracle."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def _dbl(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _round(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


_MULTIPLICITY = """
    WITH l AS (SELECT {lk} AS k, COUNT(*) AS n_l FROM {left} GROUP BY 1),
         r AS (SELECT {rk} AS k, COUNT(*) AS n_r FROM {right} WHERE {rk} IS NOT NULL GROUP BY 1)
    SELECT CAST(SUM(n_l) AS BIGINT) AS left_rows,
           CAST(COALESCE(SUM(n_l) FILTER (WHERE n_r IS NOT NULL), 0) AS BIGINT) AS matched_rows,
           CAST(SUM(COALESCE(n_l * n_r, 0)) AS BIGINT) AS output_rows,
           MAX(n_r) AS max_right_rows, ROUND(AVG(n_r), 6) AS mean_right_rows,
           ROUND(SUM(COALESCE(n_l * n_r, 0)) / SUM(n_l), 6) AS factor, MAX(n_r) > 1 AS one_to_many
    FROM l LEFT JOIN r ON l.k = r.k"""


@bind("join_multiplicity", _MULTIPLICITY.format(left="orders", lk="o_orderkey", right="lineitem", rk="l_orderkey"))
def _(t):
    df = J.join_multiplicity(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    return _round(_big(df, "output_rows"), "factor", "mean_right_rows")


@bind(
    "join_multiplicity_customer_orders",
    _MULTIPLICITY.format(left="customer", lk="c_custkey", right="orders", rk="o_custkey"),
)
def _(t):
    df = J.join_multiplicity(t.customer, t.orders, "c_custkey", "o_custkey")
    return _round(_big(df, "output_rows"), "factor", "mean_right_rows")


@bind(
    "fanout_proof",
    """
    SELECT COUNT(*) AS joined_rows, COUNT(DISTINCT c_custkey) AS grain_rows,
           ROUND(COUNT(*) / GREATEST(1, COUNT(DISTINCT c_custkey)), 6) AS factor
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = c_custkey""",
)
def _(t):
    others = {"orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")}
    return _round(_big(J.fanout_proof(t.customer, "c_custkey", "c_custkey", others), "joined_rows"), "factor")


@bind(
    "fanout_proof_repeated_key",
    """
    SELECT COUNT(*) AS joined_rows, COUNT(DISTINCT l_orderkey) AS grain_rows,
           ROUND(COUNT(*) / GREATEST(1, COUNT(DISTINCT l_orderkey)), 6) AS factor
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def _(t):
    df = J.fanout_proof(t.lineitem, "l_orderkey", "l_orderkey", {"orders": (t.orders, "o_orderkey")}, pk_unique=False)
    return _round(_big(df, "joined_rows"), "factor")


@bind(
    "fanout_children",
    """
    WITH o AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1),
         e AS (SELECT user_id AS k, COUNT(*) AS n FROM events GROUP BY 1),
         j AS (SELECT c_custkey, COALESCE(o.n, 0) AS no, COALESCE(e.n, 0) AS ne
               FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey)
    SELECT COUNT(*) AS parent_rows, CAST(SUM(no) AS BIGINT) AS orders_rows, CAST(SUM(ne) AS BIGINT) AS events_rows,
           CAST(SUM(no * ne) AS BIGINT) AS crossed_rows,
           COUNT(*) FILTER (WHERE no * ne > GREATEST(no, ne)) AS multiplied_parents,
           CAST(MAX(no * ne) AS BIGINT) AS max_crossed_per_parent, 'events' AS offending_child
    FROM j""",
)
def _(t):
    children = {"orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")}
    df = J.fanout_children(t.customer, "c_custkey", children, measure_of="orders")
    return _big(df, "crossed_rows", "max_crossed_per_parent")


@bind(
    "inflated_measure",
    """
    WITH o AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS m FROM orders),
         naive AS (SELECT c_mktsegment, SUM(m) AS s, COUNT(m) AS n, MIN(m) AS lo, MAX(m) AS hi
                   FROM customer JOIN o ON o_custkey = c_custkey JOIN events ON user_id = c_custkey GROUP BY 1),
         good AS (SELECT c_mktsegment, SUM(m) AS s, COUNT(m) AS n FROM customer JOIN o ON o_custkey = c_custkey
                  WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) GROUP BY 1)
    SELECT naive.c_mktsegment, CAST(naive.s AS DOUBLE) AS naive_sum, CAST(good.s AS DOUBLE) AS true_sum,
           ROUND(CAST(naive.s AS DOUBLE) / naive.n, 6) AS naive_avg, ROUND(CAST(good.s AS DOUBLE) / good.n, 6) AS true_avg,
           CAST(lo AS DOUBLE) AS min_value, CAST(hi AS DOUBLE) AS max_value,
           ROUND(CAST(naive.s AS DOUBLE) / CAST(good.s AS DOUBLE), 6) AS factor, naive.s <> good.s AS is_error
    FROM naive JOIN good ON naive.c_mktsegment = good.c_mktsegment""",
)
def inflated_measure_by_segment(t):
    df = J.inflated_measure(
        _money(t.orders, "o_totalprice"), "o_custkey", "o_totalprice", {"events": (t.events, "user_id")},
        t.customer, "c_custkey", ["c_mktsegment"],
    )
    return _round(_dbl(df, "naive_sum", "true_sum", "min_value", "max_value"), "naive_avg", "true_avg", "factor")


@bind(
    "preaggregated_join",
    """
    SELECT c_mktsegment, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS n_orders,
           CAST(MAX(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS largest
    FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) GROUP BY 1""",
)
def _(t):
    aggs = {"revenue": ("sum", "o_totalprice"), "n_orders": ("count", "o_totalprice"), "largest": ("max", "o_totalprice")}
    df = J.preaggregated_join(
        _money(t.orders, "o_totalprice"), "o_custkey", aggs, t.customer, "c_custkey", ["c_mktsegment"],
        must_exist=[(t.events, "user_id")],
    )
    return _dbl(df, "revenue", "largest")


@bind(
    "count_parent_vs_child",
    """
    SELECT n_name, COUNT(*) AS joined_count, COUNT(DISTINCT c_custkey) AS parent_count,
           ROUND(COUNT(*) / COUNT(DISTINCT c_custkey), 6) AS factor
    FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def _(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return _round(J.count_parent_vs_child(named, "c_custkey", t.orders, "o_custkey", ["n_name"]), "factor")


@bind(
    "grain_mismatch",
    """
    WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS m FROM orders),
         b AS (SELECT COUNT(*) AS n, SUM(m) AS s FROM o),
         j AS (SELECT COUNT(*) AS n, SUM(m) AS s FROM o JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT b.n AS base_count, CAST(b.s AS DOUBLE) AS base_sum, ROUND(CAST(b.s AS DOUBLE) / b.n, 6) AS base_avg,
           j.n AS joined_count, CAST(j.s AS DOUBLE) AS joined_sum, ROUND(CAST(j.s AS DOUBLE) / j.n, 6) AS joined_avg
    FROM b, j""",
)
def _(t):
    df = J.grain_mismatch(_money(t.orders, "o_totalprice"), "o_orderkey", t.lineitem, "l_orderkey", "o_totalprice")
    return _round(_dbl(_big(df, "joined_count"), "base_sum", "joined_sum"), "base_avg", "joined_avg")


@bind(
    "row_count_flag",
    """
    WITH a AS (SELECT COUNT(*) AS actual FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
         e AS (SELECT COUNT(*) AS expected FROM orders),
         r AS (SELECT expected, actual, actual / expected AS ratio FROM a, e WHERE expected > 0)
    SELECT expected, actual, ROUND(ratio, 6) AS ratio,
           CASE WHEN ratio > 1.5 THEN 'inflated' WHEN ratio < 0.5 THEN 'dropping' ELSE 'ok' END AS row_class,
           CASE WHEN ratio > 1.5 THEN printf('%.1f×', ratio) WHEN ratio < 0.5 THEN printf('%.0f%%', ratio * 100)
                ELSE printf('%.2f×', ratio) END AS ratio_text
    FROM r""",
)
def _(t):
    actual = J.join_multiplicity(t.orders, t.lineitem, "o_orderkey", "l_orderkey").select("output_rows")
    return _round(J.row_count_flag(actual, t.orders.agg(F.count(F.lit(1)).alias("n"))), "ratio")


@bind(
    "cross_join_size",
    f"""
    WITH s AS (SELECT (SELECT COUNT(*) FROM customer) AS customer_rows, (SELECT COUNT(*) FROM part) AS part_rows,
                      (SELECT COUNT(*) FROM nation) AS nation_rows),
         p AS (SELECT *, customer_rows * part_rows * nation_rows AS predicted_rows FROM s)
    SELECT customer_rows, part_rows, nation_rows, predicted_rows,
           CASE WHEN predicted_rows >= {J.EXPLOSIVE_PRODUCT} THEN 'explosive'
                WHEN predicted_rows >= {J.LARGE_PRODUCT} THEN 'large' ELSE 'small' END AS risk
    FROM p""",
)
def _(t):
    return _big(J.cross_join_size({"customer": t.customer, "part": t.part, "nation": t.nation}), "predicted_rows")


@bind(
    "cross_join_bounded",
    """
    SELECT m.month, p.o_orderpriority
    FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders) m,
         (SELECT DISTINCT o_orderpriority FROM orders) p""",
)
def _(t):
    months = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return J.cross_join_bounded(months, t.orders.select("o_orderpriority").distinct(), limit=100_000)


@bind(
    "suspicious_join_key",
    """
    WITH c AS (SELECT DISTINCT c_custkey AS v FROM customer),
         a AS (SELECT 'o_orderkey' AS left_column, o_orderkey AS v FROM orders GROUP BY 2
               UNION ALL SELECT 'o_custkey', o_custkey FROM orders GROUP BY 2),
         s AS (SELECT left_column, 'c_custkey' AS right_column, COUNT(a.v) AS left_values, COUNT(c.v) AS matched_values,
                      ROUND(COUNT(c.v) / COUNT(a.v), 6) AS coverage
               FROM a LEFT JOIN c ON a.v = c.v GROUP BY 1)
    SELECT *, coverage = MAX(coverage) OVER () AS is_best FROM s""",
)
def _(t):
    pairs = [("o_orderkey", "c_custkey"), ("o_custkey", "c_custkey")]
    return _round(J.suspicious_join_key(t.orders, t.customer, pairs), "coverage")


@bind(
    "coalesce_key_collision",
    """
    WITH s AS (
      SELECT (SELECT COUNT(*) FROM orders_n WHERE o_custkey IS NULL) AS left_null_rows,
             (SELECT COUNT(*) FROM orders_n WHERE o_custkey = 0) AS left_default_rows,
             (SELECT COUNT(*) FROM customer WHERE c_custkey IS NULL) AS right_null_rows,
             (SELECT COUNT(*) FROM customer WHERE c_custkey = 0) AS right_default_rows,
             (SELECT COUNT(*) FROM orders_n JOIN customer ON o_custkey = c_custkey) AS true_matches,
             (SELECT COUNT(*) FROM orders_n JOIN customer ON COALESCE(o_custkey, 0) = COALESCE(c_custkey, 0))
               AS coalesced_matches)
    SELECT *, coalesced_matches - true_matches AS false_matches FROM s""",
)
def _(t):
    df = J.coalesce_key_collision(t.orders_n, "o_custkey", t.customer, "c_custkey", 0)
    return _big(df, "true_matches", "false_matches", "coalesced_matches")


_DATED_FACTS = """
    f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_custkey
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _dated_facts(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).drop(
        "o_orderkey"
    )


@bind(
    "effective_date_join",
    f"""
    WITH {_DATED_FACTS}
    SELECT f.*, h.tier FROM f JOIN customer_history h
      ON h.cust = f.o_custkey AND h.valid_from <= f.l_shipdate AND (h.valid_to IS NULL OR f.l_shipdate < h.valid_to)""",
)
def _(t):
    return J.effective_date_join(
        _dated_facts(t), "o_custkey", "l_shipdate", t.customer_history, "cust", "valid_from", "valid_to", ["tier"]
    )


_TREE_SQL = """
    SELECT COUNT(*) AS joined_rows, COUNT(DISTINCT {pk}) AS grain_rows,
           ROUND(COUNT(*) / GREATEST(1, COUNT(DISTINCT {pk})), 6) AS factor
    FROM {tables}"""


@bind(
    "fanout_join_tree",
    _TREE_SQL.format(
        pk="c_custkey",
        tables="""customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
         LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey
         LEFT JOIN events ON user_id = c_custkey AND event_type <> 'error' JOIN supplier ON s_suppkey = l_suppkey""",
    ),
)
def _(t):
    """Three levels deep, inner and left: customer over orders over lines over part and supplier, beside events."""
    lines = Joined(
        t.lineitem, "l_orderkey", "o_orderkey",
        joins=(Joined(t.part.where("p_size > 25"), "p_partkey", "l_partkey", "left"), Joined(t.supplier, "s_suppkey", "l_suppkey")),
    )
    orders = Joined(t.orders, "o_custkey", "c_custkey", joins=(lines,))
    events = Joined(t.events.where("event_type <> 'error'"), "user_id", "c_custkey", "left")
    return _round(_big(join_tree_proof(t.customer, "c_custkey", [orders, events]), "joined_rows"), "factor")


@bind(
    "fanout_join_tree_from_the_middle",
    _TREE_SQL.format(
        pk="o_orderkey",
        tables="""orders LEFT JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
         JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey""",
    ),
)
def _(t):
    region = Joined(t.region, "r_regionkey", "n_regionkey")
    nation = Joined(t.nation, "n_nationkey", "c_nationkey", joins=(Joined(t.supplier, "s_nationkey", "n_nationkey"), region))
    joins = [Joined(t.lineitem, "l_orderkey", "o_orderkey", "left"), Joined(t.customer, "c_custkey", "o_custkey", joins=(nation,))]
    return _round(_big(join_tree_proof(t.orders, "o_orderkey", joins, pk_unique=True), "joined_rows"), "factor")


# Every tier stays valid for 150 days beyond its successor's start.
_OVERLAPPING = "h AS (SELECT cust, tier, valid_from, valid_to + INTERVAL 150 DAYS AS valid_to FROM customer_history)"


def _overlapping(t):
    return t.customer_history.withColumn("valid_to", F.col("valid_to") + F.expr("INTERVAL 150 DAYS"))


@bind(
    "effective_date_join_overlapping",
    f"""
    WITH {_DATED_FACTS}, {_OVERLAPPING}
    SELECT f.*, h.tier FROM f JOIN h
      ON h.cust = f.o_custkey AND h.valid_from <= f.l_shipdate AND (h.valid_to IS NULL OR f.l_shipdate < h.valid_to)""",
)
def _(t):
    return J.effective_date_join(_dated_facts(t), "o_custkey", "l_shipdate", _overlapping(t), "cust", "valid_from", "valid_to", ["tier"])


@bind(
    "scd_version_inflation",
    f"""
    WITH {_DATED_FACTS},
         n AS (SELECT cust, COUNT(*) AS n FROM customer_history GROUP BY 1),
         d AS (SELECT COUNT(*) AS dated_rows FROM f JOIN customer_history h
                 ON h.cust = f.o_custkey AND h.valid_from <= f.l_shipdate
                    AND (h.valid_to IS NULL OR f.l_shipdate < h.valid_to)),
         a AS (SELECT COUNT(*) AS fact_rows, CAST(SUM(COALESCE(n.n, 0)) AS BIGINT) AS naive_rows, MAX(n.n) AS max_versions
               FROM f LEFT JOIN n ON n.cust = f.o_custkey)
    SELECT fact_rows, naive_rows, max_versions, dated_rows, ROUND(naive_rows / dated_rows, 6) AS inflation FROM a, d""",
)
def _(t):
    df = J.scd_version_inflation(
        _dated_facts(t), "o_custkey", "l_shipdate", t.customer_history, "cust", "valid_from", "valid_to"
    )
    return _round(_big(df, "naive_rows"), "inflation")


# The ten operators whose right-side use turns a LEFT JOIN into an inner one.
_PREDICATES = {
    "=": "o_orderstatus = 'F'",
    "!=": "o_orderstatus != 'F'",
    "<>": "o_orderpriority <> '1-URGENT'",
    ">": "o_totalprice > 400000",
    "<": "o_totalprice < 20000",
    ">=": "o_totalprice >= 400000",
    "<=": "o_totalprice <= 20000",
    "LIKE": "o_orderpriority LIKE '%LOW'",
    "NOT LIKE": "o_orderpriority NOT LIKE '%LOW'",
    "IN": "o_orderstatus IN ('F', 'P')",
    "NOT IN": "o_orderstatus NOT IN ('F', 'P')",
}


@bind(
    "left_join_filter_loss",
    " UNION ALL ".join(
        f"""
    SELECT '{name}' AS predicate, (SELECT COUNT(*) FROM customer) AS left_rows,
           (SELECT COUNT(*) FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {p}) AS rows_in_on,
           (SELECT COUNT(*) FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE {p}) AS rows_in_where,
           (SELECT COUNT(*) FROM customer WHERE NOT EXISTS
              (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {p})) AS left_rows_lost"""
        for name, p in _PREDICATES.items()
    ),
)
def _(t):
    predicates = {name: F.expr(p) for name, p in _PREDICATES.items()}
    df = J.left_join_filter_loss(t.customer, "c_custkey", t.orders, "o_custkey", predicates)
    return _big(df, "rows_in_on", "rows_in_where")


@bind(
    "inner_join_loss",
    """
    WITH j AS (SELECT o.*, c_custkey FROM orders_n o LEFT JOIN customer ON c_custkey = o_custkey)
    SELECT COUNT(*) AS left_rows, COUNT(c_custkey) AS kept_rows,
           COUNT(*) FILTER (WHERE o_custkey IS NULL) AS null_key_rows,
           COUNT(*) FILTER (WHERE o_custkey IS NOT NULL AND c_custkey IS NULL) AS unmatched_rows,
           CAST(SUM(amount) FILTER (WHERE o_custkey IS NULL) AS DOUBLE) AS null_key_measure,
           CAST(SUM(amount) FILTER (WHERE o_custkey IS NOT NULL AND c_custkey IS NULL) AS DOUBLE) AS unmatched_measure
    FROM j""",
)
def _(t):
    return _dbl(
        J.inner_join_loss(t.orders_n, "o_custkey", t.customer, "c_custkey", "amount"),
        "null_key_measure", "unmatched_measure",
    )


@bind(
    "not_in_null_hazard",
    """
    SELECT (SELECT COUNT(*) FROM customer) AS outer_rows,
           (SELECT COUNT(*) FROM orders_n WHERE o_custkey IS NULL) AS inner_null_rows,
           (SELECT COUNT(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders_n WHERE o_custkey = c_custkey))
             AS not_exists_rows,
           (SELECT COUNT(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders_n)) AS not_in_rows,
           (SELECT COUNT(*) FROM orders_n WHERE o_custkey IS NULL) > 0 AS hazard""",
)
def _(t):
    return J.not_in_null_hazard(t.customer, "c_custkey", t.orders_n, "o_custkey")


@bind(
    "anti_join_safe",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders_n WHERE o_custkey = c_custkey)""",
)
def _(t):
    return J.anti_join_safe(t.customer.select("c_custkey", "c_name"), "c_custkey", t.orders_n, "o_custkey")


@bind(
    "semi_join",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)",
)
def _(t):
    return J.semi_join(t.customer.select("c_custkey", "c_name"), "c_custkey", t.events, "user_id")


def _chain(t):
    return [(t.orders, "o_custkey", "o_orderkey"), (t.lineitem, "l_orderkey", None)]


@bind(
    "fanout_proof_chain",
    """
    SELECT COUNT(*) AS joined_rows, COUNT(DISTINCT c_custkey) AS grain_rows,
           ROUND(COUNT(*) / greatest(1, COUNT(DISTINCT c_custkey)), 6) AS factor
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey""",
)
def _(t):
    return _round(J.fanout_proof_chain(t.customer, "c_custkey", _chain(t)), "factor")


@bind(
    "inflated_measure_chain",
    """
    WITH c AS (SELECT *, CAST(c_acctbal AS DECIMAL(18,2)) AS m FROM customer),
         naive AS (SELECT c_mktsegment, SUM(m) AS s FROM c JOIN orders ON o_custkey = c_custkey
                   JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
         good AS (SELECT c_mktsegment, SUM(m) AS s FROM c WHERE EXISTS
                  (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) GROUP BY 1)
    SELECT naive.c_mktsegment, CAST(naive.s AS DOUBLE) AS naive_sum, CAST(good.s AS DOUBLE) AS true_sum,
           ROUND(CAST(naive.s AS DOUBLE) / CAST(good.s AS DOUBLE), 6) AS factor, naive.s <> good.s AS is_error
    FROM naive JOIN good ON naive.c_mktsegment = good.c_mktsegment""",
)
def _(t):
    df = J.inflated_measure_chain(_money(t.customer, "c_acctbal"), "c_custkey", "c_acctbal", _chain(t), ["c_mktsegment"])
    return _round(_dbl(df, "naive_sum", "true_sum"), "factor")
