"""Word and window hashes of whole texts as numpy arrays, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 4 << 20
CACHED_WORDS = 500_000
U64 = np.uint64
# Odd multipliers of a splitmix generator: fixed, so that every task names the same text alike.
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64 over all others."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def numbers(seed: int, count: int) -> np.ndarray:
    """``count`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


class Words(dict):
    """Word (bytes) to its 64-bit hash; bounded, as words beyond the bound are hashed again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = Words()


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word; ``bytes.split`` parts exactly at the blanks of the contracts."""
    found = text.split()
    return np.fromiter(map(WORDS.__getitem__, found), U64, len(found))


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of all words, if they are fewer."""
    size = min(size, len(words))
    factors = numbers(seed, size)
    total = np.full(len(words) - size + 1 if size else 0, size, U64)
    for j in range(size):
        total += words[j : len(words) - size + 1 + j] * factors[j]
    return mix(total)


def text_blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about ``BLOCK_BYTES`` of text each; NULL is an empty text."""
    texts = batch[column].cast(pa.binary())
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(lengths) // BLOCK_BYTES
    starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
    for start, end in zip(starts, starts[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start), [t or b"" for t in texts.slice(start, end - start).to_pylist()]
