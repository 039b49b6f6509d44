"""Join audits: fan-out, wrong grain, lost rows, unsafe keys, history joins.

Cardinalities come from per-key counts of each side. The multiplied join itself
is never built, so the work is one partial aggregate per input whatever the
fan-out, and a hot key is a single row after the map-side combine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType

from grainguard.plans.intervals import interval_keys, points_in_intervals
from grainguard.plans.shapes import (
    WIDE,
    as_list,
    key_counts,
    key_names,
    keyed,
    not_null,
    ratio,
    side_by_side,
    times,
    total,
    unpivot_row,
)
from grainguard.plans.sorted_chunks import HOT_KEY_SETTING, carry_last
from grainguard.session import cut

Keys = str | Sequence[str]


def _all_counts(df: DataFrame, keys: Keys, name: str) -> DataFrame:
    """Like key_counts, but rows with a NULL key keep their own group."""
    keys = as_list(keys)
    return keyed(df, keys).groupBy(*key_names(keys)).agg(F.count(F.lit(1)).alias(name))


# ---------------------------------------------------------------- fan-out


def join_multiplicity(left: DataFrame, right: DataFrame, left_keys: Keys, right_keys: Keys) -> DataFrame:
    """Rows in, rows out and the growth factor of an inner equi join."""
    names = key_names(as_list(left_keys))
    both = _all_counts(left, left_keys, "n_l").join(key_counts(right, right_keys, "n_r"), names, "left")
    hit = F.col("n_r").isNotNull()
    return both.agg(
        total("n_l").alias("left_rows"),
        total(F.when(hit, F.col("n_l"))).alias("matched_rows"),
        total(times("n_l", "n_r")).alias("output_rows"),
        F.coalesce(F.max("n_r"), F.lit(0)).alias("max_right_rows"),
        F.avg("n_r").alias("mean_right_rows"),
    ).select(
        "*",
        ratio("output_rows", "left_rows").alias("factor"),
        (F.col("max_right_rows") > 1).alias("one_to_many"),
    )


def fanout_proof(
    fact: DataFrame,
    fact_pk: str,
    fact_key: Keys,
    others: Mapping[str, tuple[DataFrame, Keys]],
    pk_unique: bool = True,
) -> DataFrame:
    """COUNT(*) of the joined rows beside COUNT(DISTINCT primary key) of the fact.

    Filter the inputs first. With a unique primary key the grain is the sum of
    fact rows over keys present on every side; otherwise the distinct keys of
    the surviving fact rows are counted exactly.
    """
    names = key_names(as_list(fact_key))
    sides = [key_counts(df, keys, f"n_{name}") for name, (df, keys) in others.items()]
    counts = reduce(lambda a, b: a.join(b, names), sides, key_counts(fact, fact_key, "n_fact"))
    joined = F.sum(times("n_fact", *[f"n_{name}" for name in others]))
    if pk_unique:
        both = counts.agg(F.coalesce(joined, F.lit(0)).alias("joined_rows"), total("n_fact").alias("grain_rows"))
    else:
        reached = reduce(
            lambda a, b: a.join(b, names, "left_semi"), sides, keyed(fact, as_list(fact_key), fact_pk)
        )
        both = side_by_side(
            counts.agg(F.coalesce(joined, F.lit(0)).alias("joined_rows")),
            reached.agg(F.count_distinct(fact_pk).alias("grain_rows")),
        )
    factor = ratio("joined_rows", F.greatest(F.lit(1), F.col("grain_rows")))
    return both.select("joined_rows", "grain_rows", factor.alias("factor"))


def fanout_children(
    parent: DataFrame,
    parent_key: Keys,
    children: Mapping[str, tuple[DataFrame, Keys]],
    measure_of: str | None = None,
) -> DataFrame:
    """Several children on one parent key: true child rows against cross-multiplied rows.

    The offending child is the first one that is not the measure's own table.
    """
    names = key_names(as_list(parent_key))
    counts = reduce(
        lambda a, item: a.join(key_counts(item[1][0], item[1][1], f"n_{item[0]}"), names, "left"),
        children.items(),
        key_counts(parent, parent_key, "n_parent"),
    ).fillna(0, [f"n_{c}" for c in children])
    crossed = times("n_parent", *[f"n_{c}" for c in children])
    largest = F.greatest(*[F.col(f"n_{c}") for c in children]) * F.col("n_parent")
    offending = next((c for c in children if c != measure_of), None)
    return counts.agg(
        total("n_parent").alias("parent_rows"),
        *[total(F.col("n_parent") * F.col(f"n_{c}")).alias(f"{c}_rows") for c in children],
        F.coalesce(F.sum(crossed), F.lit(0)).alias("crossed_rows"),
        F.count_if(crossed > largest).alias("multiplied_parents"),
        F.max(crossed).alias("max_crossed_per_parent"),
    ).select("*", F.lit(offending).alias("offending_child"))


# One link of a chain of joins: a table, its key to the table above, and its own key for the one below.
Link = tuple[DataFrame, Keys, Keys | None]


def chained_counts(chain: Sequence[Link]) -> DataFrame:
    """(k0, ..., n): joined rows below each key of the top table, folded from the last link up.

    One aggregate per link, so the exploded join is never built and a hot key is one row after each fold. Rows
    without a partner below count nothing, as an inner join drops them.
    """
    below = None
    for df, up, down in reversed(chain):
        ups = as_list(up)
        if below is None:
            below = key_counts(df, ups, "n")
            continue
        downs = as_list(down)
        names = key_names(ups)
        rows = df.select(*[F.col(c).alias(f"u{i}") for i, c in enumerate(ups)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(downs)])
        met = rows.join(below, key_names(downs)).where(not_null([f"u{i}" for i in range(len(ups))]))
        below = met.groupBy(*[F.col(f"u{i}").alias(n) for i, n in enumerate(names)]).agg(F.sum(F.col("n").cast(WIDE)).cast(WIDE).alias("n"))
    return below


def fanout_proof_chain(fact: DataFrame, key: Keys, chain: Sequence[Link]) -> DataFrame:
    """joined_rows, grain_rows and factor of a fact joined down a chain of tables; ``key`` is the fact's unique key."""
    names = key_names(as_list(key))
    per_key = keyed(fact, as_list(key)).join(chained_counts(chain), names)
    return per_key.agg(total("n").cast("bigint").alias("joined_rows"), F.count(F.lit(1)).alias("grain_rows")).select(
        "joined_rows", "grain_rows", ratio("joined_rows", F.greatest(F.col("grain_rows"), F.lit(1))).alias("factor")
    )


def inflated_measure_chain(
    fact: DataFrame, key: Keys, measure: str, chain: Sequence[Link], by: Sequence[str]
) -> DataFrame:
    """SUM of a fact's measure after joining down a chain, beside its SUM over the fact rows that have a match."""
    names = key_names(as_list(key))
    rows = keyed(fact, as_list(key), measure, *by).join(chained_counts(chain), names)
    naive = F.sum(weighted(measure, "n", fact.schema[measure].dataType))
    sums = rows.groupBy(*by).agg(naive.alias("naive_sum"), F.sum(measure).alias("true_sum"))
    return sums.select(
        *by, "naive_sum", "true_sum", ratio("naive_sum", "true_sum").alias("factor"),
        (F.col("naive_sum") != F.col("true_sum")).alias("is_error"),
    )


def weighted(measure: str, weight: str, type_: DataType) -> Column:
    """Measure times count, in the measure's own scale: exact for decimals and integers, DOUBLE stays DOUBLE.

    The product takes the widest decimal that keeps the scale and 18 digits of the weight.
    """
    if isinstance(type_, (DoubleType, FloatType)):
        return F.col(measure).cast("double") * F.col(weight).cast("double")
    scale = type_.scale if isinstance(type_, DecimalType) else 0
    # Spark cuts the scale of wider products to six digits; scaled up to integers, none is lost.
    shift = max(0, scale - 6)
    whole = (F.col(measure).cast(f"decimal(38,{scale})") * F.lit(10**shift).cast("decimal(19,0)")).cast(f"decimal(38,{scale - shift})")
    product = (whole.cast(f"decimal(28,{min(6, scale)})") * F.col(weight).cast("decimal(18,0)")).cast(f"decimal(38,{min(6, scale)})")
    return product if not shift else (product / F.lit(10**shift).cast("decimal(19,0)")).cast(f"decimal(38,{scale})")


def inflated_measure(
    fact: DataFrame,
    key: Keys,
    measure: str,
    others: Mapping[str, tuple[DataFrame, Keys]],
    dim: DataFrame,
    dim_key: Keys,
    by: Sequence[str],
) -> DataFrame:
    """Naive SUM/AVG/MIN/MAX over a fan-out join beside the value at the measure's own grain.

    Both come from one pass: the fact is reduced to one row per key, and a row's
    weight in the naive result is the product of the other sides' counts.
    """
    keys = as_list(key)
    names = key_names(keys)
    per_key = (
        keyed(fact, keys, measure)
        .where(not_null(names))
        .groupBy(*names)
        .agg(
            F.sum(measure).alias("m"),
            F.count(measure).alias("n"),
            F.min(measure).alias("lo"),
            F.max(measure).alias("hi"),
        )
    )
    for name, (df, other_keys) in others.items():
        per_key = per_key.join(key_counts(df, other_keys, f"n_{name}"), names)
    dims = keyed(dim, as_list(dim_key), *by)
    weight = times(F.lit(1), *[f"n_{name}" for name in others])
    grouped = (
        per_key.join(dims, names)
        .withColumn("w", weight)
        .groupBy(*by)
        .agg(
            F.sum(weighted("m", "w", per_key.schema["m"].dataType)).alias("naive_sum"),
            F.sum("m").alias("true_sum"),
            F.sum(times("n", "w")).alias("naive_n"),
            F.sum("n").alias("true_n"),
            F.min("lo").alias("min_value"),
            F.max("hi").alias("max_value"),
        )
    )
    return grouped.select(
        *by,
        "naive_sum",
        "true_sum",
        ratio("naive_sum", "naive_n").alias("naive_avg"),
        ratio("true_sum", "true_n").alias("true_avg"),
        "min_value",
        "max_value",
        ratio("naive_sum", "true_sum").alias("factor"),
        (F.col("naive_sum") != F.col("true_sum")).alias("is_error"),
    )


# How a per-key partial value is folded again at the coarser grain.
_REFOLD = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_FOLD = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def preaggregated_join(
    fact: DataFrame,
    key: Keys,
    aggs: Mapping[str, tuple[str, str]],
    dim: DataFrame,
    dim_key: Keys,
    by: Sequence[str],
    must_exist: Sequence[tuple[DataFrame, Keys]] = (),
) -> DataFrame:
    """The corrected query: reduce the fact to its key, then join the dimension.

    ``aggs`` maps output name to (sum|count|min|max, column). Children that only
    filter (``must_exist``) become semi joins and cannot multiply anything.
    """
    keys = as_list(key)
    names = key_names(keys)
    columns = sorted({c for _, c in aggs.values()})
    out = (
        keyed(fact, keys, *columns)
        .where(not_null(names))
        .groupBy(*names)
        .agg(*[_FOLD[fn](c).alias(name) for name, (fn, c) in aggs.items()])
    )
    for df, other_keys in must_exist:
        out = out.join(keyed(df, as_list(other_keys)), names, "left_semi")
    return (
        out.join(keyed(dim, as_list(dim_key), *by), names)
        .groupBy(*by)
        .agg(*[_REFOLD[fn](name).alias(name) for name, (fn, _) in aggs.items()])
    )


def count_parent_vs_child(
    parent: DataFrame, parent_key: Keys, child: DataFrame, child_key: Keys, by: Sequence[str]
) -> DataFrame:
    """COUNT(*) after joining a child beside the number of parents; ``parent_key`` is unique in ``parent``."""
    names = key_names(as_list(parent_key))
    counts = keyed(parent, as_list(parent_key), *by).join(key_counts(child, child_key, "n"), names)
    return counts.groupBy(*by).agg(
        F.sum("n").alias("joined_count"), F.count(F.lit(1)).alias("parent_count"), ratio(F.sum("n"), F.count(F.lit(1))).alias("factor")
    )


def grain_mismatch(base: DataFrame, base_key: Keys, other: DataFrame, other_key: Keys, measure: str) -> DataFrame:
    """Global COUNT/SUM/AVG over a join against the same aggregates on the base table alone."""
    keys = as_list(base_key)
    names = key_names(keys)
    per_key = (
        keyed(base, keys, measure)
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(measure).alias("m"), F.count(measure).alias("n"))
        .join(key_counts(other, other_key, "w"), names, "left")
    )
    joined = weighted("m", "w", per_key.schema["m"].dataType)
    return per_key.agg(
        total("rows").alias("base_count"),
        F.sum("m").alias("base_sum"),
        ratio(F.sum("m"), F.sum("n")).alias("base_avg"),
        total(times("rows", "w")).alias("joined_count"),
        F.sum(joined).alias("joined_sum"),
        ratio(F.sum(joined), F.sum(times("n", "w"))).alias("joined_avg"),
    )


def row_count_flag(actual: DataFrame, expected: DataFrame | int) -> DataFrame:
    """Classify an actual against an expected row count; no row when nothing was expected.

    ``actual`` (and ``expected``, unless it is a number) are one-row frames whose
    single column is the count, for example an output of join_multiplicity.
    """
    a = actual.select(F.col(actual.columns[0]).cast("bigint").alias("actual"))
    if isinstance(expected, DataFrame):
        both = side_by_side(a, expected.select(F.col(expected.columns[0]).cast("bigint").alias("expected")))
    else:
        both = a.withColumn("expected", F.lit(expected).cast("bigint"))
    r = F.col("ratio")
    return (
        both.where(F.col("expected") > 0)
        .withColumn("ratio", ratio("actual", "expected"))
        .withColumn("row_class", F.when(r > 1.5, "inflated").when(r < 0.5, "dropping").otherwise("ok"))
        .withColumn(
            "ratio_text",
            F.when(r > 1.5, F.format_string("%.1f×", r))
            .when(r < 0.5, F.format_string("%.0f%%", r * 100))
            .otherwise(F.format_string("%.2f×", r)),
        )
        .select("expected", "actual", "ratio", "row_class", "ratio_text")
    )


# ---------------------------------------------------------------- products

# Size from which a product is called large / explosive.
LARGE_PRODUCT = 10**6
EXPLOSIVE_PRODUCT = 10**9


def cross_join_size(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Size a join without a condition would have, from row counts alone."""
    counts = side_by_side(*[df.agg(F.count(F.lit(1)).alias(f"{name}_rows")) for name, df in tables.items()])
    size = F.col("predicted_rows")
    return counts.withColumn("predicted_rows", times(*[f"{name}_rows" for name in tables])).withColumn(
        "risk", F.when(size >= EXPLOSIVE_PRODUCT, "explosive").when(size >= LARGE_PRODUCT, "large").otherwise("small")
    )


def cross_join_bounded(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """An intended Cartesian product; refused when its predicted size is over ``limit``.

    The bound is checked before anything is built, and the smaller side, then
    at most sqrt(limit) rows, is the one broadcast.
    """
    n_a, n_b = a.count(), b.count()
    if n_a * n_b > limit:
        raise ValueError(f"product of {n_a} x {n_b} rows is over the limit of {limit}")
    return a.crossJoin(F.broadcast(b)) if n_b <= n_a else F.broadcast(a).crossJoin(b)


# ---------------------------------------------------------------- keys


def suspicious_join_key(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct left values, how many exist on the right, and which candidate key pair covers best."""
    rows = []
    for i, (l, r) in enumerate(pairs):
        lv = left.select(F.col(l).alias("v")).where("v IS NOT NULL").distinct()
        rv = right.select(F.col(r).alias("v"), F.lit(1).alias("hit")).where("v IS NOT NULL").distinct()
        stats = lv.join(rv, "v", "left").agg(F.count("v").alias("left_values"), F.count("hit").alias("matched_values"))
        rows.append(
            stats.select(
                F.lit(i).alias("ord"), F.lit(l).alias("left_column"), F.lit(r).alias("right_column"),
                "left_values", "matched_values", ratio("matched_values", "left_values").alias("coverage"),
            )
        )
    table = reduce(DataFrame.unionByName, rows)
    # One row per candidate pair: the sort key of the best one is folded, then marked by its number.
    entries = table.agg(
        F.max_by("ord", F.struct("coverage", (-F.col("ord")).alias("tie"))).alias("best"),
        F.collect_list(F.struct(*table.columns)).alias("all"),
    )
    return entries.select("best", F.inline("all")).select(
        "left_column", "right_column", "left_values", "matched_values", "coverage",
        (F.col("ord") == F.col("best")).alias("is_best"),
    )


def coalesce_key_collision(left: DataFrame, left_key: str, right: DataFrame, right_key: str, default) -> DataFrame:
    """Matches invented by joining on COALESCE(key, default) on both sides."""
    l = left.groupBy(F.col(left_key).alias("k")).agg(F.count(F.lit(1)).alias("n_l"))
    r = right.groupBy(F.col(right_key).alias("k")).agg(F.count(F.lit(1)).alias("n_r"))
    true_pairs = l.join(r, "k").agg(total(times("n_l", "n_r")).alias("true_matches"))

    def parts(df: DataFrame, n: str, side: str) -> DataFrame:
        return df.agg(
            total(F.when(F.col("k").isNull(), F.col(n))).alias(f"{side}_null_rows"),
            total(F.when(F.col("k") == F.lit(default), F.col(n))).alias(f"{side}_default_rows"),
        )

    false_pairs = (
        times("left_null_rows", "right_default_rows")
        + times("left_default_rows", "right_null_rows")
        + times("left_null_rows", "right_null_rows")
    )
    return (
        side_by_side(true_pairs, parts(l, "n_l", "left"), parts(r, "n_r", "right"))
        .withColumn("false_matches", false_pairs)
        .withColumn("coalesced_matches", F.col("true_matches") + F.col("false_matches"))
    )


# ---------------------------------------------------------------- history joins


def effective_date_join(
    fact: DataFrame,
    fact_key: str,
    fact_ts: str,
    history: DataFrame,
    history_key: str,
    valid_from: str,
    valid_to: str,
    attributes: Sequence[str],
) -> DataFrame:
    """Give each fact row every version valid at its time: valid_from <= t AND (valid_to IS NULL OR t < valid_to).

    Keys whose versions do not overlap are merged in time order and the latest version is carried forward, linear in
    rows even for a key with millions of both. If versions overlap, found by one look at each version's successor, a
    fact meets all versions of its key where these are at most ``FEW_VERSIONS``. Keys of more are merged as before, or
    joined by blocks of facts (``plans.intervals``) if their own versions overlap. Facts without a valid version, a key
    or a time drop out, and so do versions without a start; empty versions are valid at no time.
    """
    version = F.struct(F.col(valid_to).alias("valid_to"), *attributes)
    begun = F.col(valid_from).isNotNull() & (F.col(valid_to).isNull() | (F.col(valid_from) < F.col(valid_to)))
    versions = history.where(begun & F.col(history_key).isNotNull()).select(
        F.col(history_key).alias("_key"), F.col(valid_from).alias("_t"), F.col(valid_to).alias("_until"), version.alias("_version")
    )
    facts = fact.where(F.col(fact_key).isNotNull() & F.col(fact_ts).isNotNull()).select(
        F.col(fact_key).alias("_key"), F.col(fact_ts).alias("_t"), F.struct(*fact.columns).alias("_fact")
    )
    result = ["_fact.*", *[F.col(f"_version.{a}").alias(a) for a in attributes]]
    keys = cut(interval_keys(versions, "_key", "_t", "_until"))
    if keys.where("crosses").isEmpty():
        return _one_version(facts, versions).select(*result)
    few = min(FEW_VERSIONS, int(keys.sparkSession.conf.get(HOT_KEY_SETTING, str(FEW_VERSIONS))))
    many = keys.where(F.col("n") > few)
    if many.isEmpty():
        return _few_versions(facts, versions).select(*result)
    found = _few_versions(facts, versions.join(many, "_key", "left_anti"))
    apart, crossing = many.where("NOT crosses"), many.where("crosses")
    if not apart.isEmpty():
        found = found.union(_one_version(facts.join(apart, "_key", "left_semi"), versions.join(apart, "_key", "left_semi")).select("_fact", "_version"))
    if not crossing.isEmpty():
        own = cut(facts.join(crossing, "_key", "left_semi").withColumn("_id", F.monotonically_increasing_id()))
        pairs = points_in_intervals(own, "_t", "_id", versions.join(crossing, "_key", "left_semi"), "_t", "_until", "_key", "_version")
        found = found.union(own.join(pairs, "_id").select("_fact", "_version"))
    return found.select(*result)


# A fact may be compared with so many versions of its key; that costs less than to number it, move it and join it again.
FEW_VERSIONS = 32


def _few_versions(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """The versions of each fact, where a key has few: one exchange of the facts, and a range beside the key.

    The hash is a second join key, so that the engine deals out both sides by itself and may split a key of many facts.
    """
    asked = facts.withColumn("_hash", F.xxhash64("_key"))
    given = versions.select("_key", F.xxhash64("_key").alias("_hash"), F.col("_t").alias("_from"), "_until", "_version")
    met = asked.join(given, ["_key", "_hash"]).where("_from <= _t AND (_until IS NULL OR _t < _until)")
    return met.select("_fact", "_version")


def _one_version(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """The version of each fact, where a key has one at a time."""
    merged = versions.select("_key", "_t", F.lit(0).alias("_kind"), F.col("_version").alias("_v")).unionByName(
        facts.withColumn("_kind", F.lit(1)), allowMissingColumns=True
    )
    found = carry_last(merged, ["_key"], ["_t", "_kind"], "_v", "_version").where("_kind = 1")
    ends = F.col("_version.valid_to")
    return found.where(F.col("_version").isNotNull() & (ends.isNull() | (F.col("_t") < ends)))


def scd_version_inflation(
    fact: DataFrame,
    fact_key: str,
    fact_ts: str,
    history: DataFrame,
    history_key: str,
    valid_from: str,
    valid_to: str,
) -> DataFrame:
    """Rows of a history join on the key alone against the effective-date join."""
    naive = _all_counts(fact, fact_key, "n_fact").join(key_counts(history, history_key, "n_ver"), "k0", "left")
    dated = effective_date_join(
        fact.select(fact_key, fact_ts), fact_key, fact_ts, history, history_key, valid_from, valid_to, []
    )
    return side_by_side(
        naive.agg(
            total("n_fact").alias("fact_rows"),
            total(times("n_fact", "n_ver")).alias("naive_rows"),
            F.coalesce(F.max("n_ver"), F.lit(0)).alias("max_versions"),
        ),
        dated.agg(F.count(F.lit(1)).alias("dated_rows")),
    ).select("*", ratio("naive_rows", "dated_rows").alias("inflation"))


# ---------------------------------------------------------------- lost rows


def left_join_filter_loss(
    left: DataFrame, left_key: Keys, right: DataFrame, right_key: Keys, predicates: Mapping[str, Column]
) -> DataFrame:
    """LEFT JOIN rows with a right-side predicate in ON against the same predicate in WHERE.

    All predicates are counted in one pass over the right side.
    """
    keys = as_list(right_key)
    names = key_names(keys)
    hits = {name: f"n_{i}" for i, name in enumerate(predicates)}
    # The predicate is reduced to a flag beside the key, so its columns are not shuffled.
    flags = right.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[p.alias(hits[name]) for name, p in predicates.items()]
    )
    r = flags.where(not_null(names)).groupBy(*names).agg(*[F.count_if(F.col(c)).alias(c) for c in hits.values()])
    both = _all_counts(left, left_key, "n_l").join(r, names, "left").fillna(0, list(hits.values()))
    sums = both.agg(
        total("n_l").alias("left_rows"),
        *[total(times("n_l", F.greatest(F.col(c), F.lit(1)))).alias(f"on_{c}") for c in hits.values()],
        *[total(times("n_l", c)).alias(f"where_{c}") for c in hits.values()],
        *[total(F.when(F.col(c) == 0, F.col("n_l"))).alias(f"lost_{c}") for c in hits.values()],
    )
    return unpivot_row(
        sums,
        "predicate",
        {
            name: {
                "left_rows": F.col("left_rows"),
                "rows_in_on": F.col(f"on_{c}"),
                "rows_in_where": F.col(f"where_{c}"),
                "left_rows_lost": F.col(f"lost_{c}"),
            }
            for name, c in hits.items()
        },
    )


def inner_join_loss(left: DataFrame, left_key: str, right: DataFrame, right_key: str, measure: str) -> DataFrame:
    """Rows and measure an inner join drops, split into NULL keys and keys without a partner."""
    per_key = left.groupBy(F.col(left_key).alias("k0")).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("m"))
    present = right.select(F.col(right_key).alias("k0"), F.lit(1).alias("hit")).where("k0 IS NOT NULL").distinct()
    is_null = F.col("k0").isNull()
    orphan = F.col("k0").isNotNull() & F.col("hit").isNull()
    return per_key.join(present, "k0", "left").agg(
        total("n").alias("left_rows"),
        total(F.when(F.col("hit").isNotNull(), F.col("n"))).alias("kept_rows"),
        total(F.when(is_null, F.col("n"))).alias("null_key_rows"),
        total(F.when(orphan, F.col("n"))).alias("unmatched_rows"),
        total(F.when(is_null, F.col("m"))).alias("null_key_measure"),
        total(F.when(orphan, F.col("m"))).alias("unmatched_measure"),
    )


def not_in_null_hazard(outer: DataFrame, outer_key: str, inner: DataFrame, inner_key: str) -> DataFrame:
    """Rows NOT IN would return against NOT EXISTS, and the NULLs that make them differ.

    NOT IN is derived from counts. Running it would build the whole inner side
    on every executor (null-aware anti join).
    """
    per_key = outer.groupBy(F.col(outer_key).alias("k0")).agg(F.count(F.lit(1)).alias("n"))
    values = inner.groupBy(F.col(inner_key).alias("k0")).agg(F.count(F.lit(1)).alias("m"))
    known = values.where("k0 IS NOT NULL").select("k0", F.lit(1).alias("hit"))
    unmatched = F.col("hit").isNull()
    both = side_by_side(
        per_key.join(known, "k0", "left").agg(
            total("n").alias("outer_rows"),
            total(F.when(F.col("k0").isNull(), F.col("n"))).alias("outer_null_rows"),
            total(F.when(unmatched, F.col("n"))).alias("not_exists_rows"),
        ),
        values.agg(
            total("m").alias("inner_rows"), total(F.when(F.col("k0").isNull(), F.col("m"))).alias("inner_null_rows")
        ),
    )
    not_in = (
        F.when(F.col("inner_rows") == 0, F.col("outer_rows"))
        .when(F.col("inner_null_rows") > 0, F.lit(0))
        .otherwise(F.col("not_exists_rows") - F.col("outer_null_rows"))
    )
    return both.select(
        "outer_rows", "inner_null_rows", "not_exists_rows", not_in.cast("bigint").alias("not_in_rows"),
        (F.col("inner_null_rows") > 0).alias("hazard"),
    )


def anti_join_safe(outer: DataFrame, outer_key: Keys, inner: DataFrame, inner_key: Keys) -> DataFrame:
    """Rows without a partner (NOT EXISTS); NULLs on the inner side do no harm."""
    return _exists(outer, outer_key, inner, inner_key, "left_anti")


def semi_join(outer: DataFrame, outer_key: Keys, inner: DataFrame, inner_key: Keys) -> DataFrame:
    """Rows with a partner (EXISTS), each once."""
    return _exists(outer, outer_key, inner, inner_key, "left_semi")


def _exists(outer: DataFrame, outer_key: Keys, inner: DataFrame, inner_key: Keys, how: str) -> DataFrame:
    keys = keyed(inner, as_list(inner_key)).distinct()
    condition = reduce(
        lambda a, b: a & b, [F.col(k) == F.col(f"k{i}") for i, k in enumerate(as_list(outer_key))]
    )
    return outer.join(keys, condition, how)
