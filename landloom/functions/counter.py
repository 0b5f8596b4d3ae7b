"""Random numbers by counter: the same from Spark, numpy and SQL, on any partitioning and in any order.

A number depends on a seed and on whole numbers that say what it is for.  They
are folded to 32 bits and mixed one after the other; all products fit a signed
64-bit integer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shifts and odd multipliers of a 32-bit mixing step.
SHIFTS, FACTORS = (16, 15, 15), (0x21F0AAAD, 0x735A2D97)
MASK = 0xFFFFFFFF


def mixed(seed: int, *counters: Column) -> Column:
    """Number from 0 to 2**32 - 1 that ``seed`` and whole-number ``counters`` decide."""

    def step(h: Column, v: Column) -> Column:
        x = h.bitwiseXOR(v.bitwiseXOR(F.shiftrightunsigned(v, 32)).bitwiseAND(F.lit(MASK)))
        for shift, factor in zip(SHIFTS[:2], FACTORS, strict=True):
            x = (x.bitwiseXOR(F.shiftrightunsigned(x, shift)) * F.lit(factor)).bitwiseAND(F.lit(MASK))
        return x.bitwiseXOR(F.shiftrightunsigned(x, SHIFTS[2]))

    return F.aggregate(F.array(*(c.cast("long") for c in counters)), F.lit(seed).cast("long"), step)


def mixed_numpy(seed: int, *counters: np.ndarray) -> np.ndarray:
    """``mixed`` for arrays that broadcast."""
    h = np.uint64(seed)
    for v in counters:
        v = np.asarray(v).astype(np.int64).astype(np.uint64)
        x = h ^ ((v ^ (v >> np.uint64(32))) & np.uint64(MASK))
        for shift, factor in zip(SHIFTS[:2], FACTORS, strict=True):
            x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(MASK)
        h = x ^ (x >> np.uint64(SHIFTS[2]))
    return h


def mixed_sql(seed: int, *counters: str) -> str:
    """``mixed`` in DuckDB's SQL."""
    x = f"xor(h, xor(v, v >> 32) & {MASK})"
    for shift, factor in zip(SHIFTS[:2], FACTORS, strict=True):
        x = f"((xor({x}, {x} >> {shift}) * {factor}) & {MASK})"
    parts = ", ".join(f"({c})::BIGINT" for c in (seed, *counters))
    return f"list_reduce([{parts}], lambda h, v: xor({x}, {x} >> {SHIFTS[2]}))"


def below(n: Column, seed: int, *counters: Column) -> Column:
    """Whole number from 0 to ``n`` - 1, for ``n`` up to 2**31."""
    return F.shiftrightunsigned(mixed(seed, *counters) * n, 32)
