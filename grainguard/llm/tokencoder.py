"""Token ids in files: a context-mixing coder over independent, checksummed blocks.

A file set is a Parquet table of segments; a segment holds whole documents in order, their lengths, and its ids in
blocks of ``tablecoder.BLOCK`` ids. Its payloads are the tables that its blocks share, then one for each block, as
``tablecoder`` writes them; any block can be read with the tables alone and a damaged one harms no other; a CRC-32 of
the ids goes with it.

Earlier file sets have a payload a block and no tables; they can be read as before. There every block of ``BLOCK`` ids
starts with an empty model, which predicts the next id from the last two ids (order 2) and the last one (order 1): each
keeps the id that followed and how often it held. Whether the order-2 id comes is coded with a probability mixed from
both orders' experience, by weights that move towards the order that predicts better; if not, the order-1 id is tried,
and what neither predicts is coded in four steps of four bits by adaptive frequencies (order 0). All blocks of a segment
are coded side by side, one id of each at a time, as numpy arrays; so memory is bounded by the segment.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainguard.llm import tablecoder
from grainguard.llm.columns import stored
from grainguard.session import ship

BLOCK = 4096
SEGMENT_IDS = 1 << 21
BATCH_CHARS = 1 << 24
END = 0

FIRST, SECOND = 1 << 11, 1 << 12  # slots of order 1 and 2
SCALE = 12  # bits of a mixed probability
TOP, BOTTOM, WORD = np.uint32(1 << 24), np.uint32(1 << 16), np.uint32(2**32 - 1)  # sums of 32 bits wrap as the coder wants
NIBBLES = 1 + 16 + 256 + 1024
LIMIT, GAIN = 1 << 13, 24


class Model:
    """Predictions of all blocks of a segment; a row per block."""

    def __init__(self, rows: int):
        self.row = np.arange(rows)
        self.one = np.zeros((rows, FIRST), np.int32)  # id << 4 | confidence
        self.two = np.zeros((rows, SECOND), np.int32)
        self.mixed = np.full((rows, 2, 32), 1 << 15, np.int32)  # experience of orders 2 and 1, 16 bits
        self.weight = np.full((rows, 2), 256, np.int32)
        self.alone = np.full((rows, 16), 1 << 15, np.int32)
        self.counts = np.ones((rows * NIBBLES, 16), np.uint16)
        self.cells = self.counts.reshape(-1)
        self.last = np.zeros((2, rows), np.int64)

    def look(self, n: int) -> None:
        """Candidates of the first ``n`` blocks for their next id."""
        a, b = self.last[0, :n], self.last[1, :n]
        self.n, rows = n, self.row[:n]
        self.slot1 = (a * 0x9E37 >> 3) & (FIRST - 1)
        self.slot2 = ((a * 0x9E3B) ^ (b * 0x5BD1E) ^ (a >> 7)) & (SECOND - 1)
        one, two = self.one[rows, self.slot1], self.two[rows, self.slot2]
        self.id1, self.sure1, self.id2, self.sure2 = one >> 4, one & 15, two >> 4, two & 15
        agree = ((self.id1 == self.id2) & (self.sure1 > 0)).astype(np.int32)
        self.at2, self.at1 = self.sure2 * 2 + agree, self.sure1 * 2 + agree

    def chance(self, rows: np.ndarray) -> np.ndarray:
        """Mixed probability, in 1 << SCALE, that the order-2 candidate of ``rows`` comes."""
        p2, p1 = self.mixed[rows, 0, self.at2[rows]], self.mixed[rows, 1, self.at1[rows]]
        w2, w1 = self.weight[rows, 0], self.weight[rows, 1]
        self.p2, self.p1 = p2, p1
        return np.clip((p2 * w2 + p1 * w1) // (w2 + w1) >> (16 - SCALE), 1, (1 << SCALE) - 1)

    def learn_chance(self, rows: np.ndarray, hit: np.ndarray) -> None:
        goal = np.where(hit, 65535, 0)
        better = np.sign(np.abs(self.p1 - goal) - np.abs(self.p2 - goal)) * 8
        self.weight[rows, 0] = np.clip(self.weight[rows, 0] + better, 16, 496)
        self.weight[rows, 1] = 512 - self.weight[rows, 0]
        self.mixed[rows, 0, self.at2[rows]] = self.p2 + ((goal - self.p2) >> 4)
        self.mixed[rows, 1, self.at1[rows]] = self.p1 + ((goal - self.p1) >> 4)

    def chance1(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.alone[rows, self.sure1[rows]] >> (16 - SCALE), 1, (1 << SCALE) - 1)

    def learn_chance1(self, rows: np.ndarray, hit: np.ndarray) -> None:
        at = self.sure1[rows]
        p = self.alone[rows, at]
        self.alone[rows, at] = p + ((np.where(hit, 65535, 0) - p) >> 4)

    def learn_counts(self, table: np.ndarray, nibble: np.ndarray, total: np.ndarray) -> None:
        self.cells[table * 16 + nibble] += GAIN
        full = total + GAIN > LIMIT
        if full.any():
            at = table[full]
            self.counts[at] = (self.counts[at] >> 1) | 1

    def learn(self, ids: np.ndarray) -> None:
        """Take in the ids that came."""
        rows = self.row[: self.n]
        for table, slot, known, sure in ((self.one, self.slot1, self.id1, self.sure1), (self.two, self.slot2, self.id2, self.sure2)):
            right = (known == ids) & (sure > 0)
            less = sure >> 1
            new = np.where(right, (known << 4) | np.minimum(sure + 1, 15), np.where(less > 0, (known << 4) | less, (ids << 4) | 1))
            table[rows, slot] = new
        self.last[1, : self.n] = self.last[0, : self.n]
        self.last[0, : self.n] = ids


def context(step: int, prefix: np.ndarray) -> np.ndarray:
    """Frequency table of a step of four bits, given the bits before."""
    if step == 3:
        return 273 + ((prefix * 0x9E5) & 1023)
    return prefix + (0, 1, 17)[step]


class Encoder:
    def __init__(self, rows: int):
        self.low, self.range = np.zeros(rows, np.uint32), np.full(rows, WORD)
        self.out, self.size = np.zeros((rows, 2 * BLOCK), np.uint8), np.zeros(rows, np.int64)

    def put(self, rows: np.ndarray, start: np.ndarray, width: np.ndarray, total) -> None:
        size = self.range[rows] // np.asarray(total, np.uint32)
        low = self.low[rows] + size * start.astype(np.uint32)
        size *= width.astype(np.uint32)
        self.low[rows], self.range[rows] = low, size
        while True:  # only what moved a byte may move another
            settled = (low ^ (low + size)) < TOP
            move = np.flatnonzero(settled | (size < BOTTOM))
            if not len(move):
                break
            rows, low = rows[move], low[move]
            size = np.where(settled[move], size[move], (~low + 1) & (BOTTOM - 1))
            at = self.size[rows]
            if at.max() + 8 >= self.out.shape[1]:
                self.out = np.concatenate([self.out, np.zeros_like(self.out)], 1)
            self.out[rows, at] = low >> 24
            self.size[rows] = at + 1
            low, size = low << 8, size << 8
            self.low[rows], self.range[rows] = low, size

    def end(self) -> list[bytes]:
        tail = [(self.low >> s).astype(np.uint8) for s in (24, 16, 8, 0)]
        return [self.out[i, : self.size[i]].tobytes() + bytes(int(t[i]) for t in tail) for i in range(len(self.size))]


class Decoder:
    def __init__(self, payloads: list[bytes]):
        rows, width = len(payloads), max(map(len, payloads)) + 8
        self.data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in payloads), np.uint8).reshape(rows, width)
        self.low, self.range = np.zeros(rows, np.uint32), np.full(rows, WORD)
        self.at = np.full(rows, 4)
        self.code = np.zeros(rows, np.uint32)
        for k in range(4):
            self.code = (self.code << 8) | self.data[:, k]

    def value(self, rows: np.ndarray, total) -> np.ndarray:
        total = np.asarray(total, np.uint32)
        self.part = self.range[rows] // total
        return np.minimum((self.code[rows] - self.low[rows]) // self.part, total - np.uint32(1)).astype(np.int64)

    def take(self, rows: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        low = self.low[rows] + self.part * start.astype(np.uint32)
        size = self.part * width.astype(np.uint32)
        self.low[rows], self.range[rows] = low, size
        while True:  # only what moved a byte may move another
            settled = (low ^ (low + size)) < TOP
            move = np.flatnonzero(settled | (size < BOTTOM))
            if not len(move):
                break
            rows, low = rows[move], low[move]
            size = np.where(settled[move], size[move], (~low + 1) & (BOTTOM - 1))
            at = self.at[rows]
            self.code[rows] = (self.code[rows] << 8) | self.data[rows, np.minimum(at, self.data.shape[1] - 1)]
            self.at[rows] = at + 1
            low, size = low << 8, size << 8
            self.low[rows], self.range[rows] = low, size


def flag(p: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part of the range that stands for whether a candidate came."""
    return np.where(hit, 0, p), np.where(hit, p, (1 << SCALE) - p)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block without tables; blocks are ordered by length, longest first, and not empty. Ids have 16 bits."""
    lengths = np.array([len(b) for b in blocks])
    if any(b.min() < 0 or b.max() >= 1 << 16 for b in map(np.asarray, blocks)):
        raise ValueError("ids beyond 65,535 can't be coded")
    ids = np.zeros((lengths[0], len(blocks)), np.int32)
    for i, block in enumerate(blocks):
        ids[: len(block), i] = block
    model, coder = Model(len(blocks)), Encoder(len(blocks))
    for t in range(lengths[0]):
        n = int(np.searchsorted(-lengths, -t, "left"))
        own = ids[t, :n]
        model.look(n)
        missed = np.ones(n, bool)
        rows = np.flatnonzero(model.sure2 > 0)
        if len(rows):
            hit = own[rows] == model.id2[rows]
            coder.put(rows, *flag(model.chance(rows), hit), 1 << SCALE)
            model.learn_chance(rows, hit)
            missed[rows[hit]] = False
        rows = np.flatnonzero(missed & (model.sure1 > 0) & ~((model.sure2 > 0) & (model.id1 == model.id2)))
        if len(rows):
            hit = own[rows] == model.id1[rows]
            coder.put(rows, *flag(model.chance1(rows), hit), 1 << SCALE)
            model.learn_chance1(rows, hit)
            missed[rows[hit]] = False
        rest = np.flatnonzero(missed)
        if len(rest):
            mine = own[rest].astype(np.int64)
            for step in range(4):
                table, nibble = rest * NIBBLES + context(step, mine >> (16 - 4 * step)), (mine >> (12 - 4 * step)) & 15
                sums = np.cumsum(model.counts.take(table, 0), 1, dtype=np.int32)
                width = model.cells[table * 16 + nibble]
                coder.put(rest, sums[np.arange(len(rest)), nibble] - width, width, sums[:, -1])
                model.learn_counts(table, nibble, sums[:, -1])
        model.learn(own)
    return coder.end()


def decode_blocks(payloads: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """Ids of each block, in the order in which they were coded."""
    ids = np.zeros((lengths[0], len(payloads)), np.int32)
    model, coder = Model(len(payloads)), Decoder(payloads)
    for t in range(lengths[0]):
        n = int(np.searchsorted(-lengths, -t, "left"))
        own = ids[t, :n]
        model.look(n)
        missed = np.ones(n, bool)
        rows = np.flatnonzero(model.sure2 > 0)
        if len(rows):
            p = model.chance(rows)
            hit = coder.value(rows, 1 << SCALE) < p
            coder.take(rows, *flag(p, hit))
            own[rows[hit]] = model.id2[rows[hit]]
            model.learn_chance(rows, hit)
            missed[rows[hit]] = False
        rows = np.flatnonzero(missed & (model.sure1 > 0) & ~((model.sure2 > 0) & (model.id1 == model.id2)))
        if len(rows):
            p = model.chance1(rows)
            hit = coder.value(rows, 1 << SCALE) < p
            coder.take(rows, *flag(p, hit))
            own[rows[hit]] = model.id1[rows[hit]]
            model.learn_chance1(rows, hit)
            missed[rows[hit]] = False
        rest = np.flatnonzero(missed)
        if len(rest):
            mine = np.zeros(len(rest), np.int64)
            for step in range(4):
                table = rest * NIBBLES + context(step, mine)
                sums = np.cumsum(model.counts.take(table, 0), 1, dtype=np.int32)
                nibble = (sums <= coder.value(rest, sums[:, -1])[:, None]).sum(1)
                width = model.cells[table * 16 + nibble]
                coder.take(rest, sums[np.arange(len(rest)), nibble] - width, width)
                model.learn_counts(table, nibble, sums[:, -1])
                mine = (mine << 4) | nibble
            own[rest] = mine
        model.learn(own)
    return [ids[:n, i] for i, n in enumerate(lengths)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


SEGMENT = (
    "part int, segment int, base long, keys array<long>, lengths array<long>, "
    "block_lengths array<int>, block_crcs array<long>, payloads array<binary>"
)


def segment_row(part: int, segment: int, base: int, keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> dict:
    blocks = [ids[i : i + tablecoder.BLOCK] for i in range(0, len(ids), tablecoder.BLOCK)]
    return {
        "part": part, "segment": segment, "base": base, "keys": keys.to_pylist(), "lengths": lengths.tolist(),
        "block_lengths": [len(b) for b in blocks], "block_crcs": [checksum(b) for b in blocks], "payloads": tablecoder.encode_segment(ids),
    }


def segment_blocks(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Ids of each block of a segment, with or without tables."""
    if len(payloads) == len(lengths):
        return decode_blocks(payloads, np.array(lengths))
    try:
        flat = tablecoder.decode_segment(payloads, np.array(lengths))
    except (zlib.error, ValueError) as e:
        raise ValueError("the tables of a segment are damaged") from e
    return np.split(flat, np.cumsum(lengths)[:-1])


def segments_of(docs: DataFrame, tokenizer: str, key: str, text: str) -> DataFrame:
    """The segments of all documents in ascending key order; ``tokenizer`` is the tokenizers library's JSON text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer)  # a vocabulary file, a few MB
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    ordered = own.repartitionByRange("key", "hash", "tie").sortWithinPartitions("key", "hash", "tie").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker is one of many on its machine
        from grainguard.llm.wordids import word_ids

        words = word_ids(shared.value)
        part, segment, base = TaskContext.get().partitionId(), 0, 0
        kept, size = [], 0
        schema = pa.schema(
            [("part", pa.int32()), ("segment", pa.int32()), ("base", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
             ("block_lengths", pa.list_(pa.int32())), ("block_crcs", pa.list_(pa.int64())), ("payloads", pa.list_(pa.binary()))]
        )

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal kept, size, segment, base
            if kept:
                keys, lengths, ids = zip(*kept, strict=True)
                row = segment_row(part, segment, base, pa.concat_arrays(keys), np.concatenate(lengths), np.concatenate(ids))
                yield pa.RecordBatch.from_pylist([row], schema)
                segment, base = segment + 1, base + size
                kept, size = [], 0

        for batch in batches:
            group = np.cumsum(pc.utf8_length(batch["text"]).to_numpy()) // BATCH_CHARS
            for begin, n in zip(*(x.tolist() for x in np.unique(group, return_index=True, return_counts=True)[1:]), strict=True):
                keys = batch["key"].slice(begin, n)
                ids, lengths = words.encode(batch["text"].slice(begin, n))
                ids, lengths = np.insert(ids, np.cumsum(lengths), END), lengths + 1
                while n:
                    fits = min(int(np.searchsorted(np.cumsum(lengths), SEGMENT_IDS - size)) + 1, n)  # the last one may be longer
                    own = int(lengths[:fits].sum())
                    kept.append((keys[:fits], lengths[:fits], ids[:own]))
                    keys, lengths, ids, n, size = keys[fits:], lengths[fits:], ids[own:], n - fits, size + own
                    if size >= SEGMENT_IDS:
                        yield from flush()
        yield from flush()

    return ordered.mapInArrow(run, SEGMENT)


def write_ids(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append id 0 to each document, and write the ids in ascending key order to ``path``.

    NULL is an empty text: its only id is 0. A NULL key sorts first; rows with equal keys are ordered by a hash of
    their text, equal rows as they are read. Other columns are not read. An empty table gives a file set without
    segments.
    """
    segments_of(docs, tokenizer, key, text).write.parquet(path)


def read_documents(segments: DataFrame, name: str, kind: str, of: Callable[[memoryview], object]) -> DataFrame:
    """(part, doc_id, start_in_part, n_tokens) of each document, and what ``of`` makes of its ids' bytes; fails if a block's checksum is wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks = segment_blocks(row["payloads"], row["block_lengths"])
                for i, (block, crc) in enumerate(zip(blocks, row["block_crcs"], strict=True)):
                    if checksum(block) != crc:
                        raise ValueError(f"block {i} of segment {row['segment']} in part {row['part']} is damaged")
                flat = memoryview(np.concatenate(blocks).astype("<u4").tobytes())
                ends = np.cumsum(row["lengths"])
                n = len(ends)
                made = [of(flat[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), row["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array(row["keys"], pa.int64()),
                        pa.array(row["base"] + ends - np.array(row["lengths"]), pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array(made, pa.int64() if kind == "long" else pa.binary()),
                    ],
                    ["part", "doc_id", "start_in_part", "n_tokens", name],
                )

    return segments.mapInArrow(run, f"part int, doc_id long, start_in_part long, n_tokens long, {name} {kind}")


def read_ids(segments: DataFrame) -> DataFrame:
    """(part, doc_id, start_in_part, n_tokens, token_ids) of each document; fails if a block's checksum is wrong."""
    return read_documents(segments, "token_ids", "binary", bytes)


def digests(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a file set that was read."""
    sizes = segments.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    # A row per written part; their running sum is the only order over all.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = stored(parts.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("first")), "parts")
    read = read_documents(segments, "ids_crc32", "long", zlib.crc32)  # the ids themselves needn't leave the worker
    return read.join(first, read.part == first.p).select(
        "doc_id", (F.col("first") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
