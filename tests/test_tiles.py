"""Rasters as dense tiles against rows of pixels."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.operators import raster as R
from landloom.operators import tiles as L

KINDS = "px_row long, px_col long, a tinyint, b double, c bigint, d float"


@pytest.fixture(scope="module")
def rasters(spark):
    rng, out = np.random.default_rng(6), []
    for k in range(2):
        places = [(int(r), int(c)) for r in range(-9, 12) for c in range(-4, 17) if rng.random() < 0.7]
        rows = [(r, c, None if rng.random() < 0.2 else int(rng.integers(-128, 128)), None if rng.random() < 0.2 else float(rng.normal()), int(rng.integers(-(2**62), 2**62)), None) for r, c in places]
        names = "px_row px_col a b c d" if not k else "px_row px_col e f g h"
        out.append(spark.createDataFrame(rows, KINDS).toDF(*names.split()).repartition(3))
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_tiles_hold_every_pixel(spark, rasters, tmp_path):
    for size in (4, 7, 256):
        made = L.dense(rasters[0], size)
        assert rows(L.pixels_of(made)) == rows(rasters[0])
    L.stored(made, str(tmp_path))
    some = L.opened(spark, str(tmp_path), 256, {"b": "double"})
    assert rows(L.pixels_of(some)) == rows(rasters[0].select("px_row", "px_col", "b"))
    assert "c_ok" not in some.rows._jdf.queryExecution().executedPlan().toString()
    assert L.pixels_of(L.dense(rasters[0].filter("false"), 4)).count() == 0
    with pytest.raises(TypeError):
        L.dense(rasters[0].withColumn("t", F.lit("x")))
    with pytest.raises(ValueError):
        L.dense(rasters[0].withColumn("a_ok", F.lit(1)))


@pytest.mark.parametrize("move", [(0, 0), (4, -8), (3, -2), (-5, 0), (0, 9)])
def test_stacks_of_tiles_are_those_of_pixels(rasters, move):
    one, two = rasters
    got = L.pixels_of(L.stacked(L.shifted(L.dense(one, 4), *move), L.dense(two, 4)))
    want = R.aligned(one, [two], move)
    assert rows(got) == rows(want.select(got.columns)) and got.count() > 50
    with pytest.raises(ValueError):
        L.stacked(L.dense(one, 4), L.dense(one, 4))
    with pytest.raises(ValueError):
        L.stacked(L.dense(one, 4), L.dense(two, 8))


@pytest.mark.parametrize("window", [(-9, 11, -4, 16), (0, 3, 0, 3), (-2, 5, 3, 3), (100, 110, 0, 5)])
def test_windows_of_tiles(rasters, window):
    got = L.pixels_of(L.windowed(L.dense(rasters[0], 4), *window))
    r0, r1, c0, c1 = window
    assert rows(got) == rows(rasters[0].filter(F.col("px_row").between(r0, r1) & F.col("px_col").between(c0, c1)))
