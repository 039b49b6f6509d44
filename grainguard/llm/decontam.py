"""Test items inside documents: size-partitioned MinHash containment search with exact verification.

A text's set is its distinct five-word shingles, lower-cased in A-Z. An item is inside a document when at least
``percent`` of the item's shingles are shingles of the document; the document may be of any length.

Items are partitioned by set size (powers of two). Within a class each item is sketched by its *k* smallest
hashes (bottom-k MinHash), where *k* is one more than the shingles an item of that class may miss: a document
that holds enough of an item then holds at least one hash of its sketch, so the search loses nothing. Documents
probe with all their shingles, and only the classes whose least overlap their own size allows. Shingles that
many items share are sketched last, so a stock phrase of the items pairs few of them. Candidates are verified
by the exact shared shingles (128 hash bits each) of candidate documents alone.

Nothing is hinted: sketches and candidates are written and read back, so Spark knows their sizes, broadcasts
them below its threshold and shuffles them beyond it. Documents are exploded map-side inside one code stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainguard.llm.columns import SHINGLE, SIMILAR_PERCENT, lower_ascii, stored, words


def shingle_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, m, h, g): a row per shingle position; *m* positions in all, two independent 64-bit hashes."""
    split = df.select(F.col(key).alias("key"), words(lower_ascii(F.col(text))).alias("w"))
    counted = split.select("key", "w", F.size("w").alias("n")).where("n > 0")
    last = F.greatest(F.col("n") - SHINGLE, F.lit(0))
    placed = counted.select("key", "w", (last + 1).alias("m"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    parts: list[Column] = [F.get("w", F.col("i") + j) for j in range(SHINGLE)]
    return placed.select("key", "m", F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(1), *parts).alias("g"))


def item_tables(items: DataFrame, key: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """All shingles of the items, and the sketches that documents probe."""
    sets = shingle_rows(items, key, text).select(F.col("key").alias("item_id"), "h", "g").distinct()
    size = F.count("h").over(Window.partitionBy("item_id"))
    shared = F.count("h").over(Window.partitionBy("h"))
    sets = stored(sets.select("*", size.alias("q"), shared.alias("shared")), "items")
    # Size class [2^c, 2^(c+1)): the least overlap of its smallest set, the sketch of its largest.
    floor = F.expr("shiftleft(1L, length(bin(q)) - 1)")
    top = 2 * floor - 1
    need = F.floor((floor * percent + 99) / 100)
    sketch = top - F.floor((top * percent + 99) / 100) + 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("shared", "h", "g"))
    sketches = sets.select("item_id", "h", need.alias("need"), sketch.alias("k"), rank.alias("rank"))
    return sets, stored(sketches.where("rank <= k").select("item_id", "h", "need"), "sketches")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    percent: int = SIMILAR_PERCENT,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles) of every item inside a document.

    A text with fewer than five words is one shingle, its whole sequence; without words or NULL it has none and
    takes no part. Rows with equal keys are one document or item; a NULL key is a key like any other. Other
    columns are not read. Empty tables give an empty result. Shingles that repeat count once.
    """
    sets, sketches = item_tables(items, item_key, text, percent)
    probes = shingle_rows(docs, doc_key, text)
    met = probes.join(sketches, (probes.h == sketches.h) & (probes.m >= sketches.need))
    candidates = stored(met.select(F.col("key").alias("doc_id"), "item_id").distinct(), "candidates")

    ids = candidates.select(F.col("doc_id").alias("id")).distinct()
    own = docs.select(F.col(doc_key).alias("key"), F.col(text).alias("text"))
    own = own.join(ids, F.col("key").eqNullSafe(F.col("id")), "left_semi")
    held = shingle_rows(own, "key", "text").select(F.col("key").alias("doc_id"), "h", "g").distinct()
    hits = held.join(sets.select("item_id", "h", "g", "q"), ["h", "g"]).alias("x")
    pairs = candidates.alias("c")
    same = F.col("x.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("x.item_id").eqNullSafe(F.col("c.item_id"))
    return (
        hits.join(pairs, same, "left_semi")
        .groupBy("doc_id", "item_id")
        .agg(F.max("q").alias("item_shingles"), F.count("h").alias("shared_shingles"))
        .where(F.col("shared_shingles") * 100 >= F.col("item_shingles") * percent)
    )


def without_items(docs: DataFrame, items: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """``docs`` without those that hold an item; columns and other rows are unchanged."""
    held = contained_items(docs, items, percent).select(F.col("doc_id").alias("__held")).distinct()
    # The list grows with the documents, so it is never broadcast: one plan at every size.
    return docs.join(held.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__held")), "left_anti")
