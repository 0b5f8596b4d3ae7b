"""Rasters as rows of pixels: mosaics, warps, neighbourhoods, statistics and composites."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["px_row", "px_col"]
#: Side of the tiles in which neighbourhoods are worked on.
TILE = 256


def haloed(pixels: DataFrame, reach: int, size: int = TILE) -> DataFrame:
    """Pixels with the square tile (_tr, _tc) they lie in, and copies for other tiles at most ``reach`` away.

    Only pixels near a tile's border are copied.  A pixel without a place is left out.
    """

    def tiles(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size))

    return pixels.withColumn("_tr", F.explode(tiles("px_row"))).withColumn("_tc", F.explode(tiles("px_col")))


class Places:
    """Dense array of the rows of one tile by place, -1 where there is none."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, reach: int):
        self.top, self.left = int(rows.min()) - reach, int(cols.min()) - reach
        self.at = np.full((int(rows.max()) - self.top + reach + 1, int(cols.max()) - self.left + reach + 1), -1, np.int64)
        self.at[rows - self.top, cols - self.left] = np.arange(len(rows))

    def rows(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Rows that lie at places, which may be far outside."""
        r, c = rows - self.top, cols - self.left
        held = (r >= 0) & (c >= 0) & (r < self.at.shape[0]) & (c < self.at.shape[1])
        return np.where(held, self.at[np.where(held, r, 0), np.where(held, c, 0)], -1)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _own(t: pa.Table, key: tuple, size: int) -> np.ndarray:
    """Rows of a haloed tile that lie in it."""
    return np.flatnonzero((_numbers(t, "px_row") // size == key[0].as_py()) & (_numbers(t, "px_col") // size == key[1].as_py()))


def with_neighbours(pixels: DataFrame, value: str, steps: dict[str, tuple[int, int]], size: int = TILE) -> DataFrame:
    """Pixels with one column for each of ``steps`` (rows, columns): the value so far away, null where there is none.

    Pixels are dealt by tile, with a halo as wide as the longest step, so one
    row per pixel is shuffled and not one per pair.  A place has one pixel.
    """
    reach = max(abs(k) for s in steps.values() for k in s)
    names, kind = pixels.columns, pixels.schema[value].dataType

    def run(key: tuple, t: pa.Table) -> pa.Table:
        own, r, c = _own(t, key, size), _numbers(t, "px_row"), _numbers(t, "px_col")
        places, out = Places(r, c, reach), t.select(names).take(pa.array(own))
        for name, (dr, dc) in steps.items():
            near = places.rows(r[own] + dr, c[own] + dc)
            out = out.append_column(name, t.column(value).take(pa.array(near, mask=near < 0)))
        return out

    schema = T.StructType([*pixels.schema.fields, *(T.StructField(n, kind, True) for n in steps)])
    return haloed(pixels, reach, size).groupBy("_tr", "_tc").applyInArrow(run, schema)


def mosaic(tiles: DataFrame, rule: str) -> DataFrame:
    """G28 ``last``: the last tile, with its nodata; G29 ``last_valid``; G30 ``first_valid``."""
    if rule == "last":
        value = F.max_by(F.struct("value"), "tile")["value"]
    elif rule == "last_valid":
        value = F.max_by(F.when(F.col("value").isNotNull(), F.col("value")), F.when(F.col("value").isNotNull(), F.col("tile")))
    elif rule == "first_valid":
        value = F.min_by(F.when(F.col("value").isNotNull(), F.col("value")), F.when(F.col("value").isNotNull(), F.col("tile")))
    else:
        raise ValueError(f"unknown rule: {rule}")
    return tiles.groupBy(*KEY).agg(value.alias("value"))


def filled_seams(pixels: DataFrame, value: str = "value", size: int = TILE) -> DataFrame:
    """Pixels without a value take that of the nearest valid one of their eight neighbours; ties by place."""
    near = sorted(((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c), key=lambda s: (s[0] ** 2 + s[1] ** 2, -s[0], -s[1]))
    steps = {f"_near{k}": s for k, s in enumerate(near)}
    return with_neighbours(pixels, value, steps, size).withColumn(value, F.coalesce(value, *steps)).drop(*steps)


def interior(pixels: DataFrame, reach: int, value: str = "class_id", size: int = TILE) -> DataFrame:
    """Pixels whose whole neighbourhood has their class; a pixel without a class has no such neighbourhood.

    Inside a tile a square is uniform if its middle column is, and the rows
    through it are: 4 times ``reach`` shifts of the array instead of a square's number.
    """
    names = pixels.columns

    def run(key: tuple, t: pa.Table) -> pa.Table:
        r, c = _numbers(t, "px_row"), _numbers(t, "px_col")
        places = Places(r, c, reach)
        codes = pc.fill_null(t.column(value).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        grid = np.where(places.at >= 0, codes[places.at], -1)
        ok = grid >= 0
        for axis in (1, 0):
            same = ok.copy()
            for k in range(1, reach + 1):
                for step in (k, -k):
                    same &= (np.roll(grid, step, axis) == grid) & np.roll(ok, step, axis)
            ok = same
        own = _own(t, key, size)
        return t.select(names).take(pa.array(own[ok[r[own] - places.top, c[own] - places.left]]))

    return haloed(pixels, reach, size).groupBy("_tr", "_tc").applyInArrow(run, pixels.schema)


def hillshade(dem: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, size: int = TILE) -> DataFrame:
    """Shade 0..1 of an elevation raster; differences are central, one-sided at edges."""
    n = with_neighbours(dem.select(*KEY, "z").filter("z is not null"), "z", {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}, size)

    def slope(before: str, after: str) -> Column:
        a, b = F.coalesce(F.col(before), F.col("z")), F.coalesce(F.col(after), F.col("z"))
        steps = F.when(F.col(before).isNotNull(), 1).otherwise(0) + F.when(F.col(after).isNotNull(), 1).otherwise(0)
        return F.coalesce(F.try_divide(b - a, steps), F.lit(0.0))

    x, y = slope("up", "down"), slope("left", "right")
    tilt = F.lit(3.141592653589793 / 2) - F.atan(F.sqrt(x * x + y * y))
    aspect = F.atan2(-x, y)
    az, alt = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    shade = F.sin(alt) * F.sin(tilt) + F.cos(alt) * F.cos(tilt) * F.cos(az - aspect)
    return n.select(*KEY, F.least(F.greatest((shade + 1) / 2, F.lit(0.0)), F.lit(1.0)).alias("shade"))


def _cubic(d: np.ndarray) -> np.ndarray:
    """Cubic convolution with a slope of -1/2 at distance 1."""
    return np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))


def _cubic_spline(d: np.ndarray) -> np.ndarray:
    """Uniform cubic B-spline."""
    return np.where(d < 1, 2 / 3 - d * d * (1 - d / 2), np.where(d < 2, (2 - d) ** 3 / 6, 0.0))


#: Half width of a kernel in pixels, and its weight at a distance.
KERNELS = {
    "bilinear": (1, lambda d: np.maximum(1 - d, 0.0)),
    "cubic": (2, _cubic),
    "cubicspline": (2, _cubic_spline),
    "lanczos": (3, lambda d: np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0.0)),
}


def _resampled(source: DataFrame, target: DataFrame, method: str, value: str, widen: float, size: int) -> DataFrame:
    """Weighted values of target cells; cells and the source pixels around them meet by tile of the source."""
    half, kernel = KERNELS[method]
    reach = math.ceil(half * widen)

    def run(key: tuple, cells: pa.Table, src: pa.Table) -> pa.Table:
        total, weight = np.zeros(len(cells)), np.zeros(len(cells))
        if len(cells) and len(src):
            places = Places(_numbers(src, "px_row"), _numbers(src, "px_col"), reach)
            v, held = _numbers(cells, "v") - 0.5, _numbers(src, "_v")
            u = _numbers(cells, "u") - 0.5
            for a in range(1 - reach, reach + 1):
                for b in range(1 - reach, reach + 1):
                    r, c = np.floor(v).astype(np.int64) + a, np.floor(u).astype(np.int64) + b
                    at = places.rows(r, c)
                    w = np.where(at >= 0, kernel(np.abs(v - r) / widen) * kernel(np.abs(u - c) / widen), 0.0)
                    total, weight = total + w * held[at], weight + w
        empty = np.abs(weight) < 1e-6
        got = pa.array(total / np.where(empty, 1.0, weight), pa.float64(), mask=empty)
        return cells.select(KEY).append_column(value, got)

    cells = target.select(*KEY, F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    cells = cells.withColumns({"_tr": F.floor(F.floor(F.col("v") - 0.5) / size), "_tc": F.floor(F.floor(F.col("u") - 0.5) / size)})
    src = haloed(source.select(*KEY, F.col(value).cast("double").alias("_v")).filter("_v is not null"), reach, size)
    schema = T.StructType([*(target.schema[k] for k in KEY), T.StructField(value, T.DoubleType(), True)])
    return cells.groupBy("_tr", "_tc").cogroup(src.groupBy("_tr", "_tc")).applyInArrow(run, schema)


def warped(source: DataFrame, target: DataFrame, method: str, value: str = "value", widen: float = 1.0, size: int = TILE) -> DataFrame:
    """Values of target cells by ``nearest``, ``bilinear``, ``cubic``, ``cubicspline``, ``lanczos`` or ``average``.

    ``target`` has px_row, px_col and the place u (column) and v (row) of the
    cell's centre in pixels of the source; for ``average`` source pixels carry
    the cell they fall in as t_row and t_col.  Weights of valid neighbours are
    scaled to a sum of 1; cells without one are null.  ``widen`` stretches the
    kernel where a target cell is that many source pixels wide.
    """
    if method == "average":
        inside = source.groupBy(F.col("t_row").alias("px_row"), F.col("t_col").alias("px_col")).agg(F.avg(value).alias(value))
        return target.select(*KEY).join(inside, KEY, "left")
    if method == "nearest":
        src = source.select(F.col("px_row").alias("_r"), F.col("px_col").alias("_c"), F.col(value).alias("_v")).filter("_v is not null")
        at = target.select(*KEY, F.floor("v").alias("_r"), F.floor("u").alias("_c"))
        return at.join(src, ["_r", "_c"], "left").select(*KEY, F.col("_v").alias(value))
    if method not in KERNELS:
        raise ValueError(f"unknown method: {method}")
    return _resampled(source, target, method, value, max(widen, 1.0), size)


def downsampled(pixels: DataFrame, height: int, width: int, most: int) -> DataFrame:
    """Every k-th pixel of a raster so that no side is over ``most``."""
    k = -(-max(height, width) // most)
    return pixels.filter((F.col("px_row") % k == k // 2) & (F.col("px_col") % k == k // 2)).withColumns({"px_row": F.expr(f"px_row div {k}"), "px_col": F.expr(f"px_col div {k}")})


def clipped(pixels: DataFrame, features: DataFrame, cell: float) -> DataFrame:
    """Pixels (x, y) inside a feature; the others are left out."""
    from landloom.operators.vector import pixels_in

    return pixels_in(pixels, features.select("rings"), cell, "left_semi")


def clipped_and_warped(pixels: DataFrame, features: DataFrame, cell: float, target: DataFrame, method: str, value: str = "value") -> DataFrame:
    """Pixels (x, y) inside a feature, resampled onto cells of another grid or reference system.

    ``target`` has the place u, v of each cell's centre in pixels of the source,
    which G14 gives for a cell in metres; what is cut off counts as missing.
    """
    return warped(clipped(pixels, features, cell), target, method, value)


def valid_extent(pixels: DataFrame, value: str) -> DataFrame:
    """First and last row and column that hold a value, of all pixels if none does."""
    ok = F.col(value).isNotNull()
    out = [f(F.when(ok, F.col(c))) for c in KEY for f in (F.min, F.max)]
    rest = [f(c) for c in KEY for f in (F.min, F.max)]
    return pixels.agg(*(F.coalesce(a, b).alias(n) for a, b, n in zip(out, rest, ("row0", "row1", "col0", "col1"), strict=True)))


def within_buffer(pixels: DataFrame, left: float, bottom: float, right: float, top: float, buffers: tuple[float, float, float, float]) -> DataFrame:
    """Pixels (x, y) within bounds widened by a distance on each side."""
    return pixels.filter(F.col("x").between(left - buffers[0], right + buffers[2]) & F.col("y").between(bottom - buffers[1], top + buffers[3]))


def statistics(pixels: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Least, greatest, mean and population deviation, valid and missing pixels and the valid share."""
    c = F.col(value)
    return pixels.groupBy(*by).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count(c).alias("n_valid"), F.count_if(c.isNull()).alias("n_missing"), (F.count(c) / F.count("*")).alias("valid_share"))


def coverage(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """Percent of pixels with all values, and without."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return pixels.agg((F.count_if(ok) * 100.0 / F.count("*")).alias("pct_valid"), (F.count_if(~ok) * 100.0 / F.count("*")).alias("pct_missing"))


def median_composite(observations: DataFrame, keep: Column) -> DataFrame:
    """Median of the kept observations per pixel and band."""
    return observations.filter(keep).groupBy("pixel", "band").agg(F.median("dn").alias("dn"))


def gap_filled(observations: DataFrame, first: Column, second: Column, nodata: int) -> DataFrame:
    """Median of a first season, of a second one where it has none, else nodata."""
    return observations.groupBy("pixel", "band").agg(F.coalesce(F.median(F.when(first, F.col("dn"))), F.median(F.when(second, F.col("dn"))), F.lit(nodata)).alias("dn"))


def mode_composite(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Commonest value per key, the smallest on ties."""
    return rows.groupBy(*keys).agg(F.mode(value, True).alias(value))


def linked(scenes: DataFrame, scores: DataFrame) -> DataFrame:
    """Scenes with their quality score, null where there is none."""
    return scenes.join(scores, "scene", "left")


def nearest_scenes(scenes: DataFrame, target: str, n: int) -> DataFrame:
    """The ``n`` scenes nearest to a time, the lower number on ties."""
    off = F.abs(F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit(target).cast("timestamp")))
    return scenes.withColumn("off_ms", off).orderBy("off_ms", "scene").limit(n)


def nearest_per_pixel(observations: DataFrame, target: str) -> DataFrame:
    """Value nearest to a time per pixel and band."""
    off = F.abs(F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit(target).cast("timestamp")))
    return observations.groupBy("pixel", "band").agg(F.min_by("dn", F.struct(off, "scene")).alias("dn"))


def same_day_mosaic(observations: DataFrame, day: str) -> DataFrame:
    """Last valid value of one day per pixel and band."""
    ok = F.col("qa").isNotNull()
    return observations.filter(F.to_date("ts") == F.lit(day).cast("date")).groupBy("pixel", "band").agg(F.max_by(F.when(ok, F.col("dn")), F.when(ok, F.struct("ts", "scene"))).alias("dn"))


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected tiles without a file; leave empty files out of ``present`` to count them as missing."""
    return expected.join(present, keys, "left_anti")


def aligned(label: DataFrame, stack: list[DataFrame], offsets: tuple[int, int] = (0, 0)) -> DataFrame:
    """One row per pixel that all rasters have; the label's window starts at ``offsets`` of the others."""
    out = label.withColumns({"px_row": F.col("px_row") + offsets[0], "px_col": F.col("px_col") + offsets[1]})
    for s in stack:
        out = out.join(s, KEY)
    return out


def as_tiles(pixels: DataFrame, value: str, size: int) -> DataFrame:
    """One row per tile with its values in order of row and column."""
    keyed = pixels.withColumns({"tile_r": F.expr(f"px_row div {size}"), "tile_c": F.expr(f"px_col div {size}")})
    cells = F.array_sort(F.collect_list(F.struct("px_row", "px_col", F.col(value).alias("v"))))
    return keyed.groupBy("tile_r", "tile_c").agg(cells.alias("cells"))


def from_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles as rows of pixels."""
    return tiles.select(F.explode("cells").alias("x")).select("x.px_row", "x.px_col", F.col("x.v").alias("value"))


def one_nodata(value: Column, values: list[int]) -> Column:
    """Null for all of several nodata values."""
    return F.when(~value.isin(values), value)


def float_band(vector: str, k: int) -> Column:
    """Band ``k``, from 0, of a vector as a 32-bit float."""
    return F.get(F.col(vector), F.lit(k)).cast("float")
