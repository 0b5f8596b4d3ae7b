"""Rounding of doubles as numpy and databases do it: by a scale, ties away from zero, with the sign of zero kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_round(x: Column, digits: int = 6) -> Column:
    """``x`` times 10 ** ``digits``, rounded, and divided again.

    Spark's own ``round`` goes by decimal numbers, so it turns -1e-7 into 0.0
    where this gives -0.0, and leaves large numbers as they are where this
    scales them.  Numbers too large to scale stay.
    """
    scale, inf = F.lit(10.0**digits), F.lit(float("inf"))
    y = x * scale
    even = F.rint(y)
    away = F.when((F.abs(y - even) == 0.5) & (F.abs(even) < F.abs(y)), even + F.signum(y)).otherwise(even)
    return F.when(F.abs(y) < inf, away / scale).otherwise(x)
