"""Event claims on a stream, exact in whatever order the attempts arrive, at a cost per batch that history does not raise.

What an attempt must know of all earlier ones of its key is one number, the gate. A key's attempts are kept as keyed
state in periods of event time, each with the gate it leaves and a link to the period before. A batch opens, of the
keys it touches, the periods from its earliest attempt on: the one being filled when attempts come in order, those
after a late attempt otherwise. It goes on to the next stored period only while the gate differs from the one that
period was taken with. Only outcomes that are new or have changed are written, and those parts are merged by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from grainguard.operators.claims import FREE, fold
from grainguard.session import ship
from grainguard.streaming import files, levels


class ClaimHistory(StatefulProcessor):
    """State of one key: ``head`` is its latest period, ``links`` has each period's predecessor and the gate it leaves,
    ``periods`` its attempts in order of time and number, with their outcomes."""

    def __init__(self, key: str, attempt: str, attempt_type: str, stale: int, period: int):
        self.key, self.attempt, self.attempt_type = key, attempt, attempt_type
        self.stale, self.period = stale, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "period long")
        self.links = handle.getMapState("links", "period long", "before long, gate long")
        kept = f"t array<long>, attempt array<{self.attempt_type}>, completed array<boolean>, failed array<boolean>, outcome array<string>"
        self.periods = handle.getMapState("periods", "period long", kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[tuple]] = {}
        for part in rows:
            for t, attempt, done, bad in zip(*(part[c].tolist() for c in ("t", "attempt", "completed", "failed")), strict=True):
                fresh.setdefault(t // self.period, []).append((t, attempt, bool(done), bool(bad), None))
        changed = self.take(fresh)
        if changed:
            attempts, outcomes = zip(*changed, strict=True)
            keys = pd.Series([key[0]] * len(changed), dtype=object)
            yield pd.DataFrame({self.key: keys, self.attempt: list(attempts), "outcome": list(outcomes)})

    def take(self, fresh: dict[int, list[tuple]]) -> list[tuple]:
        """Put attempts into their periods; (attempt, outcome) of all whose outcome is new."""
        first = min(fresh)
        stored: dict[int, tuple[int | None, int]] = {}  # from the first touched period on
        at = self.head.get()[0] if self.head.exists() else None
        head = at
        while at is not None:
            link = self.links.getValue((at,))
            if at < first:
                break
            stored[at] = (link[0], link[1])
            at = link[0]
        before, gate = at, FREE if at is None else link[1]
        left = {at: gate} | {p: out for p, (_, out) in stored.items()}  # gates as they were
        changed: list[tuple] = []
        for period in sorted({*stored, *fresh}):
            old_before, old_out = stored.get(period, (None, None))
            if period in fresh or gate != left[old_before]:
                rows = fresh.get(period, [])
                if period in stored:
                    rows = [*zip(*self.periods.getValue((period,)), strict=True), *rows]
                rows.sort(key=lambda r: r[:2])
                t, attempt, done, bad, known = map(list, zip(*rows, strict=True))
                found, out = fold(t, done, bad, gate, self.stale)
                changed += [(a, new) for a, new, old in zip(attempt, found, known, strict=True) if new != old]
                self.periods.updateValue((period,), (t, attempt, done, bad, found))
            else:
                out = old_out
            if period not in stored or (old_before, old_out) != (before, out):
                self.links.updateValue((period,), (before, out))
            before, gate = period, out
        if head is None or before > head:
            self.head.update((before,))
        return changed

    def close(self) -> None:
        pass


def stream_claims(
    deliveries: DataFrame,
    out: str,
    key: str,
    ts: str,
    attempt: str,
    completed: str,
    failed: str | None = None,
    stale_seconds: int = 300,
    period_seconds: int = 86_400,
    fanout: int = levels.FANOUT,
) -> str:
    """Run the stream over all there is; the path of its outcomes, for ``outcomes_of``.

    Outcomes are those of ``claim_events`` on all attempts so far; nothing is dropped for being late and no key is
    forgotten. A NULL key is a key, a NULL time comes first, a NULL flag is false. A repeated batch finds the state and
    the parts as they were before it. A key's attempts of one batch and the periods it opens pass through one task;
    shorter periods bound that where a key has very many attempts.
    """
    spark = deliveries.sparkSession
    ship(spark)
    rows = deliveries.select(
        F.col(key),
        F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(FREE // 2)).alias("t"),
        F.col(attempt).alias("attempt"),
        F.coalesce(F.col(completed), F.lit(False)).alias("completed"),
        F.coalesce(F.col(failed) if failed else F.lit(False), F.lit(False)).alias("failed"),
    )
    types = dict(rows.dtypes)
    processor = ClaimHistory(key, attempt, types["attempt"], stale_seconds * 1_000_000, period_seconds * 1_000_000)
    labelled = rows.groupBy(key).transformWithStateInPandas(
        processor, f"`{key}` {types[key]}, `{attempt}` {types['attempt']}, outcome string", "Update", "None"
    )

    def numbered(batch: DataFrame, batch_id: int) -> DataFrame:
        return batch.withColumn(files.BATCH, F.lit(batch_id).cast("long"))

    return levels.run_folded(labelled, out, numbered, lambda parts: files.latest(parts, [key, attempt]), "update", fanout)


def outcomes_of(spark: SparkSession, path: str, key: str, attempt: str) -> DataFrame:
    """The last outcome of each attempt."""
    return files.latest(levels.read_parts(spark, path), [key, attempt]).drop(files.BATCH)
