"""Byte-level BPE over whole texts: padded numpy matrices, one merge per row and round.

A text is parted by the vocabulary's pattern. Pieces that are tokens themselves are looked up; the rest go,
grouped by length, into padded matrices of token ids. In each round every row merges its leftmost pair of
the lowest rank; the pairs' ranks come from a hashed table probed for whole matrices at once, and merged rows
are compacted by one column. Rows without a known pair leave the matrix. A round costs a row its length, so pieces of
more than ``LONG_PIECE`` bytes are merged one by one with a heap of their pairs instead, to the same result.

Only the map side works: no shuffle, so copies and hot sources cost nothing extra. Memory is bounded by a
block of texts (``BLOCK_CHARS``), a bounded cache of pieces, and the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainguard.llm.columns import without
from grainguard.llm.merging import merge
from grainguard.session import ship

BLOCK_CHARS = 1 << 20
MATRIX_CELLS = 1 << 20
LONG_PIECE = 1024
CACHED_PIECES = 400_000
NONE = np.int32(2**31 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing table from a pair of token ids to the rank of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        slots = self.slots(keys)
        while len(keys):
            free = self.keys[slots] == np.iinfo(np.uint64).max
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            placed = first[free[first]]
            self.keys[slots[placed]] = keys[placed]
            self.ranks[slots[placed]] = rank[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, rank, slots = keys[rest], rank[rest], (slots[rest] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; ``NONE`` for unknown ones and for padding (negative ids)."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[at].astype(np.uint64) << np.uint64(32)) | right.ravel()[at].astype(np.uint64)
        slots = self.slots(keys)
        flat = out.ravel()
        while len(at):
            there = self.keys[slots]
            hit = there == keys
            flat[at[hit]] = self.ranks[slots[hit]]
            on = ~hit & (there != np.iinfo(np.uint64).max)
            at, keys, slots = at[on], keys[on], (slots[on] + 1) & self.mask
        return flat.reshape(left.shape)


class Merges:
    """A vocabulary of ranks, ready to encode pieces and decode ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ranks[token[:cut]], ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.pairs = PairTable(*np.array(pairs or np.empty((0, 3)), np.int32).reshape(-1, 3).T)
        self.single = {left << 32 | right: rank << 32 | rank for left, right, rank in pairs}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.lengths: list[int] = []

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece of one length bucket."""
        width = max(map(len, pieces))
        cells = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = self.byte_ids[cells]
        ids[np.arange(width) >= np.array([len(p) for p in pieces])[:, None]] = -1
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(pieces))
        done: list[np.ndarray] = [None] * len(pieces)
        while len(row):
            here = np.arange(len(row))
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[here, at]
            else:
                best = np.full(len(row), NONE)
            ended = best == NONE
            if ended.any():
                for r, line in zip(row[ended], ids[ended], strict=True):
                    done[r] = line[line >= 0]
                on = ~ended
                row, ids, rank = row[on], ids[on], rank[on]
                if not len(row):
                    break
                here, at, best = np.arange(len(row)), at[on], best[on]
            ids[here, at] = best
            stay = np.ones(ids.shape, bool)
            stay[here, at + 1] = False
            ids = ids[stay].reshape(len(row), -1)
            stay = np.ones(rank.shape, bool)
            stay[here, at] = False
            rank = rank[stay].reshape(len(row), -1)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.pairs.find(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < rank.shape[1])
            rank[after, at[after]] = self.pairs.find(ids[after, at[after]], ids[after, at[after] + 1])
        return done

    def learn(self, fresh: list[str]) -> None:
        """Encode pieces not met before and remember them."""
        raw = [piece.encode("utf-8") for piece in fresh]
        found: list[np.ndarray | None] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                found[k] = np.array([whole], np.int32)
            elif len(piece) > LONG_PIECE:
                found[k] = np.array(merge(self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), self.single), np.int32)
            else:
                buckets.setdefault(len(piece).bit_length(), []).append(k)
        for bucket, members in buckets.items():
            step = max(1, MATRIX_CELLS >> bucket)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for k, ids in zip(part, self.merge_rows([raw[k] for k in part]), strict=True):
                    found[k] = ids
        for piece, ids in zip(fresh, found, strict=True):
            self.known[piece] = len(self.ids)
            self.ids.append(ids)
            self.lengths.append(len(ids))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each piece has."""
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if len(self.known) + len(fresh) > CACHED_PIECES:
            self.forget()
            fresh = list(dict.fromkeys(pieces))
        self.learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        lengths = np.array(self.lengths or [0], np.int64)
        flat = np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)
        starts = np.cumsum(lengths) - lengths
        own = lengths[at]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.repeat(starts[at] - (ends - own), own) + np.arange(total)], own

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; a text longer than a block is taken in parts between pieces."""
        pieces: list[str] = []
        ends = []
        for text in texts:
            if len(text) > BLOCK_CHARS:
                return [ids for part in texts for ids in self.encode_long(part)]
            pieces += self.pattern.findall(text)
            ends.append(len(pieces))
        ids, own = self.encode_pieces(pieces)
        cuts = np.concatenate([[0], np.cumsum(own)])[ends]
        return np.split(ids, cuts[:-1]) if texts else []

    def encode_long(self, text: str) -> list[np.ndarray]:
        found = (m[0] for m in self.pattern.finditer(text))
        parts = []
        while chunk := list(islice(found, BLOCK_CHARS >> 3)):
            parts.append(self.encode_pieces(chunk)[0])
        return [np.concatenate(parts) if parts else np.empty(0, np.int32)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


BUILT: dict[str, Merges] = {}


def digest(ranks: dict[bytes, int], pattern: str) -> str:
    """Names a vocabulary by all its tokens and ranks."""
    whole = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        whole.update(b"%d:%d:%s" % (rank, len(token), token))
    return whole.hexdigest()


def merges_of(ranks: dict[bytes, int], pattern: str, key: str) -> Merges:
    """One vocabulary per worker process; it outlives a task."""
    if key not in BUILT:
        BUILT.clear()
        BUILT[key] = Merges(ranks, pattern)
    return BUILT[key]


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``BLOCK_CHARS`` characters of text each."""
    lengths = np.array([0 if n is None else n for n in pc.binary_length(batch[column]).to_pylist()], np.int64)
    block = np.cumsum(lengths) // BLOCK_CHARS
    starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
    for start, end in zip(starts, starts[1:], strict=False):
        if end > start:
            part = batch.slice(start, end - start)
            yield part, [text or "" for text in part[column].to_pylist()]


def ranks_in(path: str) -> dict[bytes, int]:
    """A rank file: one token in base 64 and its rank per line. Read on the driver; such files are of fixed size."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", decoded: str | None = None
) -> DataFrame:
    """``docs`` with ``token_ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and, if a name is
    given, that column with the bytes that the ids decode to.

    A NULL or empty text has no tokens. Rows are neither dropped nor merged, so repeated rows repeat. Columns of
    ``docs`` that have one of the added names are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    added = ["token_ids", "n_tokens"] + ([decoded] if decoded else [])
    kept = without(docs, *added)
    # Fixed size: a vocabulary file, about 1 MB.
    shared = spark.sparkContext.broadcast((ranks, pattern, digest(ranks, pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(*shared.value)
        for batch in batches:
            for part, texts in blocks(batch, text):
                ids = merges.encode(texts)
                columns = [
                    pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                    pa.array([len(i) for i in ids], pa.int64()),
                ]
                if decoded:
                    columns.append(pa.array([merges.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *added])

    schema = T.StructType(list(kept.schema.fields))
    schema = schema.add("token_ids", T.BinaryType()).add("n_tokens", T.LongType())
    if decoded:
        schema = schema.add(decoded, T.BinaryType())
    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, ranks: dict[bytes, int], name: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its ``token_ids`` in column ``name``; NULL ids decode to no bytes."""
    spark = coded.sparkSession
    ship(spark)
    kept = without(coded, name)
    tokens = spark.sparkContext.broadcast({rank: token for token, rank in ranks.items()})  # fixed size, as above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = tokens.value.__getitem__
        for batch in batches:
            raw = [b"".join(map(find, np.frombuffer(ids or b"", "<u4").tolist())) for ids in batch["token_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, name])

    return kept.mapInArrow(run, T.StructType(list(kept.schema.fields)).add(name, T.BinaryType()))


def digests(coded: DataFrame) -> DataFrame:
    """One row per document: token count, SHA-256 of the ids and of the decoded bytes."""
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
