"""Histogram sort into shards of near equal bytes.

The rows' order is that of a key, then of a tie-breaker. Splitters between shards are searched, not sampled:
each pass counts the exact bytes and rows between candidate boundaries in every partition, adds the counts up
and narrows every splitter's interval, until the bytes below it are within the tolerance of their target (0:
the very row). Only then do the rows move, once, each to the piece that its key falls in, and are sorted there.

* A key that holds many rows is cut inside by the tie-breaker, so no shard must take all of it.
* The passes read a written copy of (key, tie-breaker, size), about 1 % of the texts. The driver gets counts
  per candidate boundary: their number depends on shards and pieces, not on rows.
* A shard is ``pieces`` tasks of about ``PIECE_BYTES``, so shards may be larger than a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainguard.llm.columns import crc, without
from grainguard.session import cut, ship

ROW_BYTES = 16
PIECE_BYTES = 128 << 20
PIECES_PER_SHARD = 1000
PROBES = 1 << 16
LOWEST = -(2**63)

Position = tuple[int, int]


def place(keys: np.ndarray, ties: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """How many of the ordered positions ``at`` = (keys, ties) are not above each row."""
    low, high = np.searchsorted(at[0], keys, "left"), np.searchsorted(at[0], keys, "right")
    for start in np.unique(low[high > low]):  # keys that positions cut: at most one per splitter
        rows = np.flatnonzero((low == start) & (high > low))
        low[rows] += np.searchsorted(at[1][start : high[rows[0]]], ties[rows], "right")
    return low


def packed(positions: list[Position]) -> list[np.ndarray]:
    return [np.array([p[i] for p in positions], np.int64) for i in (0, 1)]


@dataclass
class Splitter:
    """A boundary that is searched for: bytes and rows below both ends of the interval it lies in."""

    target: int
    tolerance: int
    low: Position
    high: Position
    low_bytes: int
    high_bytes: int
    low_rows: int
    high_rows: int

    @property
    def found(self) -> bool:
        return self.high_bytes - self.target <= self.tolerance or self.high_rows - self.low_rows <= 1

    def probes(self, count: int, last_tie: int) -> list[Position]:
        (key, tie), (end, end_tie) = self.low, self.high
        if end - key >= 2:
            steps = {key + (end - key) * i // count for i in range(1, count)}
            return [(k, 0) for k in steps if k > key] + ([(end, 0)] if end_tie else [])
        if end > key:
            if end_tie:
                return [(end, 0)]
            end_tie = last_tie + 1
        return [(key, t) for t in {tie + (end_tie - tie) * i // count for i in range(1, count)} if t > tie]

    def narrow(self, probes: list[Position], bytes_below: np.ndarray, rows_below: np.ndarray) -> None:
        i = int(np.searchsorted(bytes_below, self.target, "left"))
        if i < len(probes) and probes[i] < self.high:
            self.high, self.high_bytes, self.high_rows = probes[i], int(bytes_below[i]), int(rows_below[i])
        if i and probes[i - 1] > self.low:
            self.low, self.low_bytes, self.low_rows = probes[i - 1], int(bytes_below[i - 1]), int(rows_below[i - 1])


def histogram(narrow: DataFrame, probes: list[Position]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe."""
    at, bins = packed(probes), len(probes) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for batch in batches:
            where = place(batch["k"].to_numpy(), batch["tie"].to_numpy(), at)
            np.add.at(size, where, batch["size"].to_numpy())
            rows += np.bincount(where, minlength=bins)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, size[some], rows[some])], ["bin", "size", "n"])

    counted = narrow.mapInArrow(count, "bin long, size long, n long").groupBy("bin")
    size, rows = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
    for r in counted.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():  # one row per probe at most
        size[r.bin], rows[r.bin] = r.size, r.n
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def search(narrow: DataFrame, shards: int, tolerance: float) -> tuple[list[Splitter], int]:
    """Splitters of all pieces in order, and the number of pieces in each shard."""
    total, rows, first, last, last_tie = narrow.agg(
        F.sum("size"), F.count("size"), F.min("k"), F.max("k"), F.max("tie")
    ).first()
    if not rows:
        return [], 1
    pieces = max(1, min(PIECES_PER_SHARD, round(total / shards / PIECE_BYTES)))
    step = shards * pieces
    loose = total // step // 8
    splitters = [
        Splitter(-(-total * i // step), int(total / shards * tolerance) if i % pieces == 0 else loose,
                 (first, 0), (last, last_tie + 1), 0, total, 0, rows)
        for i in range(1, step)
    ]
    while open_ones := [s for s in splitters if not s.found]:
        intervals = {(s.low, s.high): s for s in open_ones}.values()
        count = max(8, min(4096, PROBES // len(intervals)))
        probes = sorted({p for s in intervals for p in s.probes(count, last_tie)})
        below = histogram(narrow, probes)
        for s in open_ones:
            s.narrow(probes, *below)
    return splitters, pieces


def shard_by_bytes(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", tolerance: float = 0.0, stored: bool = False
) -> DataFrame:
    """``docs`` in ``shards`` shards of near equal bytes, with ``size``, ``shard`` and ``slot``.

    A row's size is its text's UTF-8 bytes (NULL: none) plus 16. In the order of (key, order of reading), a row
    goes to shard *i* if the bytes before it reach *i* parts of the total, for a tolerance of 0; else a splitter
    may lie off by that share of a shard. ``slot`` counts a shard's rows from 0 without gaps. A NULL key sorts
    first; rows with equal keys are ordered as they are read, and may part. Columns of ``docs`` with the added
    names are replaced. An empty table gives an empty table.

    ``stored``: ``docs`` only reads files, so reading it again gives the same rows in the same partitions; else
    a written copy is made first.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = without(docs, "size", "shard", "slot")
    if not stored:
        docs = cut(docs)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    keyed = docs.select(
        "*",
        size.alias("size"),
        F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("__k"),
        F.monotonically_increasing_id().alias("__tie"),
    )
    narrow = cut(keyed.select(F.col("__k").alias("k"), F.col("__tie").alias("tie"), "size"))
    splitters, pieces = search(narrow, shards, tolerance)
    at = packed([s.high for s in splitters])

    @F.pandas_udf("int")
    def piece(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(place(keys.to_numpy(), ties.to_numpy(), at).astype(np.int32))

    starts = [0, *(s.high_rows for s in splitters)]
    first_rows = [(i, i // pieces, starts[i] - starts[i // pieces * pieces]) for i in range(len(starts))]
    # Fixed size: a row per piece, at most shards x PIECES_PER_SHARD.
    offsets = F.broadcast(spark.createDataFrame(first_rows, "__piece int, shard int, __first long"))
    moved = (
        keyed.withColumn("__piece", piece("__k", "__tie"))
        .repartitionById(len(starts), F.col("__piece"))
        .sortWithinPartitions("__piece", "__k", "__tie")
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return (
        moved.join(offsets, "__piece")
        .withColumn("slot", F.col("__first") + F.col("__row"))
        .drop("__piece", "__k", "__tie", "__row", "__first")
    )


def digests(sharded: DataFrame) -> DataFrame:
    return sharded.select(
        "doc_id",
        "size",
        crc(F.col("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
