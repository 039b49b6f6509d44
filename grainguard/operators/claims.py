"""Idempotent event handling: at most one live processing per delivery key.

Attempts of a key are taken in time order. The first one claims the key. Later
ones are duplicates once the claim completed, are in flight while the claim is
younger than the stale limit, and otherwise take the claim over. A handled
failure releases the claim at once.

Attempts that do not fail are spaced: the next one that is accepted is the first that comes at least the stale limit
later, and none comes after a completed one. All else follows from that chain. A key of up to ``FOLDED`` attempts is
folded as one array, piece by piece, so that its time is that of its attempts. A longer one finds each attempt's successor by an as-of lookup and marks the chain from its
first attempt by doubling the steps, so its work is spread over all tasks, in a number of rounds that grows with the
logarithm of the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.plans.sorted_chunks import HOT_KEY_SETTING, carry_last, exact_ranks, next_value
from grainguard.session import cut

# Gates outside the range of any timestamp: no claim yet / completed for good.
FREE = -(2**62)
DONE = 2**62


def gate_after(t: int, completed: bool, failed: bool, stale: int) -> int:
    """Gate left by an accepted attempt at ``t``."""
    return DONE if completed else FREE if failed else t + stale


def fold(t: list, completed: list, failed: list, gate: int, stale: int) -> tuple[list, int]:
    """Outcomes of one key's attempts in time order, and the gate after them."""
    n = len(t)
    if gate == DONE:
        return ["duplicate"] * n, DONE
    found = ["in_flight"] * n
    for i, at in enumerate(t):
        if at >= gate:
            found[i] = "processed" if gate == FREE else "reclaimed"
            gate = gate_after(at, completed[i], failed[i], stale)
            if gate == DONE:
                found[i + 1 :] = ["duplicate"] * (n - i - 1)
                break
    return found, gate


FOLDED = 65_536
PIECE = 64  # an outcome is put to its piece's by copying them, a piece's to the pieces before it in the same way
OUTCOMES = ["processed", "duplicate", "in_flight", "reclaimed"]


def claim_events(
    deliveries: DataFrame,
    key: str,
    ts: str,
    attempt: str,
    completed: str,
    failed: str | None = None,
    stale_seconds: int = 300,
) -> DataFrame:
    """Outcome per attempt: processed, duplicate, in_flight or reclaimed.

    ``attempt`` is unique per key and orders attempts of the same time. A NULL key is a key like any other, a NULL time
    comes before all others, a NULL flag is false.
    """
    spark = deliveries.sparkSession
    stale = stale_seconds * 1_000_000
    rows = deliveries.select(
        F.struct(F.col(key).alias("key")).alias("key"),
        F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(FREE // 2)).alias("t"),
        F.col(attempt).alias("attempt"),
        F.coalesce(F.col(completed), F.lit(False)).alias("completed"),
        F.coalesce(F.col(failed) if failed else F.lit(False), F.lit(False)).alias("failed"),
    )
    limit = min(FOLDED, int(spark.conf.get(HOT_KEY_SETTING, str(FOLDED))))
    long_keys = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key"))
    if long_keys.isEmpty():
        found = folded(rows, stale)
    else:
        short = folded(rows.join(long_keys, "key", "left_anti"), stale)
        found = short.union(chained(cut(rows.join(long_keys, "key", "left_semi")), stale))
    return found.select(F.col("key.key").alias(key), F.col("attempt").alias(attempt), "outcome")


def folded(rows: DataFrame, stale: int) -> DataFrame:
    """Keys of few attempts: each one's attempts, sorted in an array, are taken in order with the gate as state."""
    in_order = F.sort_array(F.collect_list(F.struct("t", "attempt", "completed", "failed")))

    def step(state: Column, a: Column) -> Column:
        accepted = a["t"] >= state["gate"]
        left = F.when(a["completed"], F.lit(DONE)).when(a["failed"], F.lit(FREE)).otherwise(a["t"] + F.lit(stale))
        code = (
            F.when(accepted, F.when(state["gate"] == FREE, 0).otherwise(3))
            .when(state["gate"] == DONE, 1)
            .otherwise(2)
            .cast("tinyint")
        )
        return F.struct(F.when(accepted, left).otherwise(state["gate"]).alias("gate"), F.concat(state["codes"], F.array(code)).alias("codes"))

    def fold_piece(state: Column, piece: Column) -> Column:
        start = F.struct(state["now"]["gate"].alias("gate"), F.array().cast("array<tinyint>").alias("codes"))
        return F.struct(F.aggregate(piece, start, step).alias("now"), F.concat(state["before"], F.array(state["now"]["codes"])).alias("before"))

    now = F.struct(F.lit(FREE).alias("gate"), F.array().cast("array<tinyint>").alias("codes"))
    begin = F.struct(now.alias("now"), F.array().cast("array<array<tinyint>>").alias("before"))
    grouped = rows.groupBy("key").agg(in_order.alias("a"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("a"), F.lit(PIECE)), lambda i: F.slice("a", i, PIECE))
    codes = F.aggregate(pieces, begin, fold_piece, lambda end: F.flatten(F.concat(end["before"], F.array(end["now"]["codes"]))))
    labelled = grouped.select("key", "a", codes.alias("codes"))
    pairs = labelled.select("key", F.explode(F.arrays_zip(F.col("a.attempt").alias("attempt"), "codes")).alias("p"))
    return pairs.select("key", F.col("p.attempt").alias("attempt"), F.get(F.array(*map(F.lit, OUTCOMES)), F.col("p.codes")).alias("outcome"))


def chained(rows: DataFrame, stale: int) -> DataFrame:
    """Keys of many attempts: the chain of accepted attempts that did not fail, then every attempt by its place in it."""
    ranked = cut(exact_ranks(rows, ["key"], "t", "attempt", kinds=["row_number"]).withColumnRenamed("row_number", "pos"))
    spaced = ranked.where("NOT failed")
    # Backwards in time, the last attempt met at or before a probe is the first one at or after its time.
    here = spaced.select("key", (-F.col("t")).alias("back"), F.lit(0).alias("probe"), (-F.col("pos")).alias("last"), "pos", F.col("pos").alias("met"))
    ahead = spaced.where("NOT completed").select(
        "key", (-(F.col("t") + F.lit(stale))).alias("back"), F.lit(1).alias("probe"), (-F.col("pos")).alias("last"), "pos", F.lit(None).cast("long").alias("met")
    )
    met = carry_last(here.union(ahead), ["key"], ["back", "probe", "last"], "met", "next")
    jumps = cut(met.where("probe = 1 AND next IS NOT NULL").select("key", "pos", "next"))
    chain = reached = cut(spaced.groupBy("key").agg(F.min("pos").alias("pos")))
    while True:  # after k rounds the chain's first 2^k attempts are marked
        reached = cut(chain.join(jumps, ["key", "pos"]).select("key", F.col("next").alias("pos")))
        if reached.isEmpty():
            break
        chain = cut(chain.union(reached))
        further = jumps.select("key", F.col("pos").alias("next"), F.col("next").alias("after"))
        jumps = cut(jumps.join(further, ["key", "next"]).select("key", "pos", F.col("after").alias("next")))

    claims = spaced.join(chain, ["key", "pos"]).select(
        "key", (F.col("pos") * 2 + 1).alias("place"), F.struct("t", "completed").alias("claim"), F.lit(None).cast(ranked.schema["attempt"].dataType).alias("attempt"),
        "t", "failed", F.lit(False).alias("asks"),
    )
    asking = ranked.select(
        "key", (F.col("pos") * 2).alias("place"), F.lit(None).cast("struct<t:bigint,completed:boolean>").alias("claim"), "attempt", "t", "failed", F.lit(True).alias("asks")
    )
    seen = carry_last(asking.union(claims), ["key"], ["place"], "claim", "held").where("asks")
    held = F.col("held")
    accepted = held.isNull() | (~held["completed"] & (F.col("t") >= held["t"] + F.lit(stale)))
    seen = seen.withColumns({"accepted": accepted, "back": -F.col("place")})
    seen = seen.withColumn("released", F.col("accepted") & F.col("failed"))
    # Right after an accepted failure, and only there, a later attempt finds the claim free again.
    seen = next_value(seen, ["key"], ["back"], "released", "free")
    outcome = (
        F.when(F.col("accepted"), F.when(F.coalesce("free", held.isNull()), "processed").otherwise("reclaimed"))
        .when(held["completed"], "duplicate")
        .otherwise("in_flight")
    )
    return seen.select("key", "attempt", outcome.alias("outcome"))
