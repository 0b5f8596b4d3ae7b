"""Sample extraction end to end: labelled pixels to capped, split and described samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.operators import grid as G
from landloom.operators import pixels as P
from landloom.operators import sampling as S


def extracted(pixels: DataFrame, block_px: int, seed: int, val: float, test: float, cap: int, order: list[str]) -> DataFrame:
    """Valid labelled pixels (area, px_row, px_col, class_id, ae), split by block and capped per class."""
    sound = pixels.filter(P.labelled() & P.all_bands())
    blocked = G.with_blocks(sound, block_px)
    split = blocked.withColumn("split", P.split_of(G.block_fraction(seed), val, test))
    return S.capped(split, ["class_id"], [F.col("area"), F.xxhash64(F.lit(seed), *order), *map(F.col, order)], cap)


def described(samples: DataFrame) -> dict[str, DataFrame]:
    """Statistics that go with a sample."""
    return {"counts": S.split_counts(samples), "sizes": S.split_sizes(samples), "features": S.feature_statistics(samples, "ae"), "weights": S.class_weights(samples.filter("split = 'train'")), "checks": S.archive_checks(samples, "ae", P.BANDS)}
