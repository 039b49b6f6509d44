"""Array expressions whose work is linear, or nearly so, in the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of an array that are folded at once: a fold copies what it has put out so far for each of its steps.
BLOCK = 64
#: Characters of a text in which a place is looked up at once.
PIECE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body, or a function in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(items: Column, size: int = BLOCK) -> Column:
    """The array in blocks; an empty array has none."""
    return let(
        items,
        lambda all_: F.when(F.size(all_) == 0, F.slice(F.array(all_), F.lit(1), F.lit(0))).otherwise(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda k: F.slice(all_, k * size + 1, F.lit(size)))
        ),
    )


def folded(items: Column, carry: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """(carry, out) after all entries: ``step`` takes the carry and an entry to the next carry and an array of entries of
    type ``out`` to put out.

    A fold copies its state at every step. So the first round only finds the carry that each block begins with, and the
    second folds every block by itself.
    """
    none = F.array().cast(f"array<{out}>")

    def one(state: Column, x: Column) -> Column:
        after, more = step(state["carry"], x)
        return F.struct(after.alias("carry"), F.concat(state["out"], more).alias("out"))

    def inner(at: Column, entries: Column) -> Column:
        return F.aggregate(entries, F.struct(at.alias("carry"), none.alias("out")), one)

    def whole(parts: Column) -> Column:
        start = F.struct(carry.alias("carry"), F.slice(F.array(carry), F.lit(1), F.lit(0)).alias("begun"))
        begun = F.aggregate(
            parts, start, lambda s, b: F.struct(inner(s["carry"], b)["carry"].alias("carry"), F.concat(s["begun"], F.array(s["carry"])).alias("begun"))
        )
        return let(
            begun,
            lambda s: F.struct(
                s["carry"].alias("carry"), F.flatten(F.transform(parts, lambda b, k: inner(F.get(s["begun"], k), b)["out"])).alias("out")
            ),
        )

    return let(blocks(items), whole)


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` characters."""
    return let(
        text,
        lambda t: F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / PIECE).cast("int")), lambda k: F.substring(t, k * PIECE + 1, F.lit(PIECE))),
    )


def between(parts: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end`` of a text in pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")

    def part(k: Column) -> Column:
        low, high = F.greatest(start - k * PIECE, F.lit(0)), F.least(end - k * PIECE, F.lit(PIECE))
        return F.substring(F.get(parts, k), low + 1, high - low)

    return F.when(start >= end, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), ""))
