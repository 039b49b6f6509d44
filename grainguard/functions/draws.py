"""Repeatable pseudo-random draws as column expressions: functions of (row id, seed, column, draw) only.

No state, no partition order: any task may compute any row, again and alike. A draw has 62 mixed bits, so no two rows
are tied together through all their columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus 2^31 - 1 and two of its well-known multipliers.
MODULUS = 2_147_483_647
STEP, SECOND_STEP = 48_271, 69_621


def salt(seed: int, place: str, draw: int) -> int:
    return zlib.crc32(f"{seed}/{place}/{draw}".encode()) % MODULUS


class Draws:
    """Draws for one column of one generated table."""

    def __init__(self, row_id: Column, seed: int, place: str):
        self.row_id = row_id
        self.seed = seed
        self.place = place

    def lanes(self, draw: int = 0) -> tuple[Column, Column]:
        """Two integers in [0, MODULUS) that are different for different ids below MODULUS squared.

        The id's remainder and quotient are turned into two numbers by an invertible linear step, and each of these
        is then moved by a square of the other, which can be undone as well. All products stay inside BIGINT.
        """
        first, second = salt(self.seed, self.place, draw), salt(self.seed, f"{self.place}/", draw)
        low, high = self.row_id % MODULUS, F.call_function("div", self.row_id, F.lit(MODULUS)) % MODULUS
        a = (low * STEP + high * SECOND_STEP + first) % MODULUS
        b = (low * SECOND_STEP + high * STEP + second) % MODULUS
        x = (b + a * (a + SECOND_STEP) % MODULUS) % MODULUS
        return x, (a + x * (x + STEP) % MODULUS) % MODULUS

    def raw(self, draw: int = 0) -> Column:
        """Integer in [0, MODULUS)."""
        return self.lanes(draw)[1]

    def integer(self, low: int, high: int, draw: int = 0) -> Column:
        return self.raw(draw) % (high - low + 1) + low

    def wide(self, low: int, high: int, draw: int = 0) -> Column:
        """As integer(), from both lanes: even over ranges of up to MODULUS squared numbers."""
        x, y = self.lanes(draw)
        return (x * MODULUS + y) % (high - low + 1) + low

    def unit(self, draw: int = 0) -> Column:
        """Double strictly inside (0, 1)."""
        return (self.raw(draw) + F.lit(0.5)) / F.lit(float(MODULUS))

    def pick(self, words: Sequence[str], draw: int = 0) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (self.raw(draw) % len(words) + 1).cast("int"))

    def normal(self, mean: float, deviation: float) -> Column:
        """Box-Muller normal draw."""
        radius = F.sqrt(F.lit(-2.0) * F.ln(self.unit(0)))
        angle = F.cos(F.lit(2.0) * F.pi() * self.unit(1))
        return F.lit(mean) + radius * angle * F.lit(deviation)
