"""Repeated word windows across a corpus, found by recompression and removed after their first occurrence.

Recompression: in each round, maximal runs of one symbol get a name, then pairs of a *left* and a *right* symbol
do (which side a symbol is on is a fixed bit of its name). Names are 64-bit hashes of what they stand for, so all
tasks name alike without a common table, and equal substrings are parsed alike inside: whether a border between
symbols survives depends on a few words on both sides, and the parse keeps track of which (``reach``).

A window's *key* is the least name among the borders it determines by itself, the name standing for the words
that the border depends on; equal windows thus have equal keys. A window without such a border has its own hash.

1. One scan writes a row per stretch of windows with one key, about one for six words. Stretches whose key is
   met twice in the corpus are candidates; keys that repeat within a block are settled there, so a key that is in
   a third of all texts reaches the shuffle once per block.
2. The windows of candidates are verified by 96 hash bits of their twenty words, again first within blocks, and
   ordered by document and start: all but the first are repeats.
3. Each text loses the words that its repeats cover.

Texts travel by document key, once, for both joins. Blocks and long texts are worked on in bounded parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainguard.llm.columns import without
from grainguard.llm.hashing import U64, mix, numbers, text_blocks, word_hashes
from grainguard.session import ship

WINDOW = 20
ROUNDS = 2
#: Words of one text that are parsed at once.
PART = 1 << 19
FAR = 1 << 40
LOWEST = -(2**63)
NONE = U64(2**64 - 1)
STEP, BACK = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SALTS = numbers(21, 16)
FIRST, SECOND = numbers(22, WINDOW), numbers(23, WINDOW)


def reach(low: np.ndarray, high: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What borders depend on after one more decision about the symbols on both their sides."""
    left, right = low.copy(), high.copy()
    left[1:] = np.minimum(low[1:], low[:-1])
    right[:-1] = np.maximum(high[:-1], high[1:])
    left[fixed], right[fixed] = -FAR, FAR
    return left, right


def borders(words: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders that survive all rounds, and the words [low, high) each depends on; ``fixed`` ones never fall."""
    at = low = high = np.arange(len(words))
    name = words
    for level in range(ROUNDS):
        low, high = reach(low, high, fixed[at])
        stay = np.ones(len(at), bool)
        stay[1:] = (name[1:] != name[:-1]) | fixed[at[1:]]
        first = np.flatnonzero(stay)
        length = np.diff(first, append=len(at)).astype(U64)
        name = np.where(length > 1, mix(name[first] + length * SALTS[4 * level]), name[first])
        at, low, high = at[first], low[first], high[first]

        low, high = reach(low, high, fixed[at])
        right = (mix(name + SALTS[4 * level + 1]) >> U64(63)).astype(bool)
        stay = np.ones(len(at), bool)
        stay[1:] = right[:-1] | ~right[1:] | fixed[at[1:]]
        first = np.flatnonzero(stay)
        paired = np.flatnonzero(np.diff(first, append=len(at)) == 2)
        both = name[first]
        both[paired] = mix(both[paired] * SALTS[4 * level + 2] + name[first[paired] + 1] * SALTS[4 * level + 3])
        name, at, low, high = both, at[first], low[first], high[first]
    return at, low, high


def window_keys(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows in the concatenated ``words``, their keys, and the border each key stands at.

    ``ends`` are the positions of the separators, one after each text.
    """
    n = len(words)
    fixed = np.zeros(n + 1, bool)
    fixed[0] = fixed[ends] = fixed[ends + 1] = True
    at, low, high = borders(words, fixed[:n])
    near = high - low <= WINDOW
    at, low, high = at[near], low[near], high[near]

    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, STEP, U64)]))
        back = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, BACK, U64)]))
        sums = np.concatenate([[U64(0)], np.cumsum(words * powers[:-1], dtype=U64)])
        content = (sums[high] - sums[low]) * back[low]
        names = mix(content + (at - low).astype(U64) * SALTS[14] + (high - low).astype(U64) * SALTS[15])

    name = np.full(n + WINDOW, NONE, U64)
    least, most = np.full(n + WINDOW, -FAR), np.full(n + WINDOW, FAR)
    name[at], least[at], most[at] = names, low, high
    start = np.arange(n)
    best, chosen = np.full(n, NONE, U64), start.copy()
    for k in range(1, WINDOW):
        own = name[k : n + k]
        fits = (least[k : n + k] >= start) & (most[k : n + k] <= start + WINDOW) & (own < best)
        np.copyto(best, own, where=fits)
        np.copyto(chosen, start + k, where=fits)
    end = np.repeat(ends, np.diff(ends, prepend=-1))
    found = np.flatnonzero(start + WINDOW <= end)
    keys = best[found]
    alone = np.flatnonzero(keys == NONE)
    with np.errstate(over="ignore"):
        own = found[alone]
        keys[alone] = mix((sums[own + WINDOW] - sums[own]) * back[own] + SALTS[13])
    return found, keys, chosen[found]


def stretches(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, first start, last start) of each stretch of windows whose keys stand at one border."""
    pieces, text, offset = [], [], []
    for i, own in enumerate(words):
        for part in range(0, max(1, len(own) - WINDOW + 1), PART):
            piece = own[part : part + PART + WINDOW - 1]
            if len(piece) >= WINDOW:
                pieces += [piece, np.zeros(1, U64)]
                text.append(i)
                offset.append(part)
    if not pieces:
        return (np.empty(0, U64), *(np.empty(0, np.int64) for _ in range(3)))
    ends = np.cumsum([len(p) for p in pieces])[1::2] - 1
    found, keys, border = window_keys(np.concatenate(pieces), ends)
    piece = np.searchsorted(ends, found)
    new = np.ones(len(found), bool)
    new[1:] = (border[1:] != border[:-1]) | (found[1:] != found[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1
    shift = np.array(offset)[piece[first]] - np.concatenate([[0], ends[:-1] + 1])[piece[first]]
    return keys[first], np.array(text)[piece[first]], found[first] + shift, found[last] + shift


#: A stretch whose key must be met elsewhere; one that is known to repeat; a sign that a key is there.
ASKS, KNOWN, SIGN = 0, 1, 2


def candidate_rows(docs: DataFrame) -> DataFrame:
    """(k, key, tie, place): stretches of windows, and signs of keys, to be counted by ``k``.

    ``place`` packs the first start (above 32 bits), how many starts follow (30 bits) and the kind: they are many rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                names, text, low, high = stretches([word_hashes(t) for t in texts])
                once, back, seen = np.unique(names, return_inverse=True, return_counts=True)
                known = seen[back] > 1
                signs = once[seen > 1]
                key, tie = part["key"].to_numpy()[text], part["tie"].to_numpy()[text]
                # Stretches known to repeat are not counted; they only need to be spread.
                k = np.where(known, mix(key.view(U64) * STEP + low.astype(U64)), names)
                zero = np.zeros(len(signs), np.int64)
                place = (low << 32) | ((high - low) << 2) | np.where(known, KNOWN, ASKS)
                columns = [np.concatenate([k, signs]).view(np.int64)]
                columns += [np.concatenate(p) for p in ((key, zero), (tie, zero), (place, zero + SIGN))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["k", "key", "tie", "place"])

    return docs.mapInArrow(run, "k long, key long, tie long, place long")


def verified_rows(held: DataFrame, column: str) -> DataFrame:
    """(h, g, __key, __tie, repeats): the first windows within a block by hash, and a text's repeats known there.

    ``g`` packs 32 more bits of the hash with the window's start.

    Rows of the latter sort have ``repeats``, the starts as 32-bit integers, and a hash that only spreads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, column):
                key, tie = part["__key"].to_numpy(), part["__tie"].to_numpy()
                ids = np.stack([key, tie], 1)
                _, rank = np.unique(ids, axis=0, return_inverse=True)
                h, g, text, at = [], [], [], []
                for i, (raw, spans) in enumerate(zip(texts, part["__spans"].to_pylist(), strict=True)):
                    words = word_hashes(raw)
                    own = np.unique(np.concatenate([np.arange(s["low"], s["high"] + 1) for s in spans]))
                    first, second = np.zeros(len(own), U64), np.zeros(len(own), U64)
                    for j in range(WINDOW):
                        word = words[own + j]
                        first += word * FIRST[j]
                        second += (word ^ SALTS[12]) * SECOND[j]
                    h.append(mix(first))
                    g.append(mix(second) >> U64(32))
                    text.append(np.full(len(own), i))
                    at.append(own)
                if not h:
                    continue
                h, g, text, at = (np.concatenate(x) for x in (h, g, text, at))
                rank = rank.ravel()[text]
                order = np.lexsort((at, rank, g, h))
                h, g, text, at, rank = h[order], g[order], text[order], at[order], rank[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                again = ~new & ((rank != rank[lead]) | (at != at[lead]))
                rows = np.flatnonzero(new)
                repeated = {}
                by_text = np.argsort(text[again], kind="stable")
                for i, starts in zip(*groups(text[again][by_text], at[again][by_text]), strict=True):
                    repeated[int(i)] = starts.astype("<i4").tobytes()
                some = np.array(sorted(repeated), np.int64)
                columns = [
                    np.concatenate([h[rows].view(np.int64), mix(key[some].view(U64)).view(np.int64)]),
                    np.concatenate([((g[rows] << U64(32)) | at[rows].astype(U64)).view(np.int64), some]),
                    np.concatenate([key[text[rows]], key[some]]),
                    np.concatenate([tie[text[rows]], tie[some]]),
                ]
                lists = pa.array([None] * len(rows) + [repeated[int(i)] for i in some], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["h", "g", "__key", "__tie", "repeats"])

    return held.mapInArrow(run, "h long, g long, __key long, __tie long, repeats binary")


def groups(labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted labels and their values."""
    if not len(labels):
        return labels, []
    cuts = np.flatnonzero(np.diff(labels)) + 1
    return labels[np.concatenate([[0], cuts])], np.split(values, cuts)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``, the words left, joined by one space.

    A word goes if a window of twenty words that covers it also starts earlier: in a document of a smaller key,
    or in the same document before. Windows are judged on the input. NULL, empty and short texts have no window
    and keep their words (NULL: none). A NULL key sorts first. Rows that share a key are ordered by a hash of
    their texts; rows that share both are one document and get the same result. Columns of ``docs`` with the added
    names are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = without(docs, "n_words", "n_removed", "kept_text")
    ordered = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    shared = docs.groupBy(ordered.alias("k")).count().where("count > 1").limit(1).count()
    tie = F.xxhash64(F.col(text)) if shared else F.lit(0).cast("long")
    # Grouped as they are joined, so that no group moves twice.
    ids = ["__key", "__tie"] if shared else ["__key"]
    keyed = docs.select("*", ordered.alias("__key"), tie.alias("__tie"))
    narrow = keyed.select(F.col("__key").alias("key"), F.col("__tie").alias("tie"), F.col(text).alias("text"))

    rows = candidate_rows(narrow).withColumn("n", F.count("k").over(Window.partitionBy("k")))
    kind = F.col("place").bitwiseAND(F.lit(3))
    found = rows.where((kind == KNOWN) | ((kind == ASKS) & (F.col("n") > 1)))
    low = F.shiftright("place", 32).cast("int")
    high = low + F.shiftright(F.col("place").bitwiseAND(F.lit(2**32 - 1)), 2).cast("int")
    spans = found.withColumnsRenamed({"key": "__key", "tie": "__tie"}).groupBy(*ids).agg(
        F.collect_list(F.struct(low.alias("low"), high.alias("high"))).alias("__spans")
    )
    # Both joins take all columns of the texts, so they share one exchange of them.
    held = keyed.join(spans, ids)
    first = verified_rows(held, text).repartition("h")
    first = first.withColumns({"at": F.col("g").bitwiseAND(F.lit(2**32 - 1)).cast("int"), "g": F.shiftright("g", 32)})
    place = F.rank().over(Window.partitionBy("h", "g").orderBy("__key", "__tie", "at"))
    judged = first.withColumn("place", place).where("repeats IS NOT NULL OR place > 1")
    starts = judged.groupBy(*ids).agg(
        F.collect_list(F.when(F.col("repeats").isNull(), F.col("at"))).alias("__one"),
        F.collect_list("repeats").alias("__many"),
    )
    joined = keyed.join(starts, ids, "left")
    kept = [c for c in docs.columns]
    schema = docs.select(*kept).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, text):
                counts, removed, left = [], [], []
                for raw, one, many in zip(texts, part["__one"].to_pylist(), part["__many"].to_pylist(), strict=True):
                    words = raw.split()
                    gone = 0
                    if one or many:
                        change = np.zeros(len(words) + 1, np.int64)
                        at = np.concatenate([np.array(one or [], np.int64), *(np.frombuffer(m, "<i4") for m in many or [])])
                        np.add.at(change, at.astype(np.int64), 1)
                        np.add.at(change, at.astype(np.int64) + WINDOW, -1)
                        stay = np.cumsum(change)[:-1] == 0
                        gone = int(len(words) - stay.sum())
                        words_left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    else:
                        words_left = words
                    counts.append(len(words))
                    removed.append(gone)
                    left.append(b" ".join(words_left))
                out = pa.array(left, pa.binary()).cast(pa.string())
                own = [part[c] for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), out],
                    [*kept, "n_words", "n_removed", "kept_text"],
                )

    return joined.mapInArrow(run, schema)


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
