"""Rasters as dense tiles: a row per tile with an array of values and two masks per band.

Pixels that a raster holds are marked in ``here``; those with a value of a band
in ``<band>_ok``.  A tile of 256 x 256 pixels of 4 bytes has 0.25 megabytes, so
joins of rasters move tiles and not pixels, and windows skip tiles unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.operators.raster import TILE

# Numbers of each column type as bytes of a tile.
KINDS = {"tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}


@dataclass(frozen=True)
class Tiles:
    """``rows`` (tile_r, tile_c, here, and per band values and mask), the side of a tile, and the column types of the bands."""

    rows: DataFrame
    size: int
    bands: dict[str, str]


def _columns(bands: dict[str, str]) -> list[str]:
    return ["here", *(c for b in bands for c in (b, f"{b}_ok"))]


def _schema(bands: dict[str, str]) -> str:
    return "tile_r long, tile_c long, " + ", ".join(f"`{c}` binary" for c in _columns(bands))


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask.ravel(), bitorder="little").tobytes()


def _mask(raw: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=size * size, bitorder="little").reshape(size, size).astype(bool)


def _batch(tiles: list[tuple[int, int, dict[str, bytes]]], bands: dict[str, str]) -> pa.RecordBatch:
    keys = [pa.array([t[k] for t in tiles], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array([t[2][c] for t in tiles], pa.binary()) for c in _columns(bands))], ["tile_r", "tile_c", *_columns(bands)])


def dense(pixels: DataFrame, size: int = TILE) -> Tiles:
    """Pixels (px_row, px_col and bands of numbers) as tiles; a place has one pixel."""
    bands = {f.name: f.dataType.simpleString() for f in pixels.schema if f.name not in ("px_row", "px_col")}
    if unknown := {b: k for b, k in bands.items() if k not in KINDS}:
        raise TypeError(f"no numbers: {unknown}")
    if {"here", "tile_r", "tile_c", *(f"{b}_ok" for b in bands)} & set(bands):
        raise ValueError("bands are not called here, tile_r, tile_c, nor as another one with _ok behind it")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        at = (t["px_row"].to_numpy() - key[0].as_py() * size) * size + t["px_col"].to_numpy() - key[1].as_py() * size
        here = np.zeros(size * size, bool)
        here[at] = True
        out = {"here": _bits(here)}
        for b, kind in bands.items():
            column = t[b].combine_chunks()
            ok, values = np.zeros(size * size, bool), np.zeros(size * size, KINDS[kind])
            ok[at] = column.is_valid().to_numpy(zero_copy_only=False)
            values[at] = column.fill_null(0).to_numpy(zero_copy_only=False)
            out |= {b: values.tobytes(), f"{b}_ok": _bits(ok)}
        return pa.Table.from_batches([_batch([(key[0].as_py(), key[1].as_py(), out)], bands)])

    keyed = pixels.withColumns({"tile_r": F.floor(F.col("px_row") / size), "tile_c": F.floor(F.col("px_col") / size)})
    return Tiles(keyed.groupBy("tile_r", "tile_c").applyInArrow(run, _schema(bands)), size, bands)


def pixels_of(tiles: Tiles) -> DataFrame:
    """Rows of pixels of tiles (px_row, px_col and bands)."""
    size, bands = tiles.size, tiles.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                r, c = np.nonzero(_mask(t["here"], size))
                values = [pa.array(np.frombuffer(t[b], KINDS[k]).reshape(size, size)[r, c], mask=~_mask(t[f"{b}_ok"], size)[r, c]) for b, k in bands.items()]
                yield pa.RecordBatch.from_arrays([pa.array(r + t["tile_r"] * size), pa.array(c + t["tile_c"] * size), *values], ["px_row", "px_col", *bands])

    return tiles.rows.mapInArrow(run, "px_row long, px_col long, " + ", ".join(f"`{b}` {k}" for b, k in bands.items()))


def _masked(tiles: Tiles, rows: DataFrame, keep) -> Tiles:
    """Tiles with only the pixels that ``keep`` leaves of a tile's row; tiles without any are left out."""
    size, bands = tiles.size, tiles.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t in batch.to_pylist():
                here = keep(t)
                if here.any():
                    kept.append((t["tile_r"], t["tile_c"], {**{c: t[c] for c in _columns(bands)}, "here": _bits(here)}))
            if kept:
                yield _batch(kept, bands)

    return Tiles(rows.mapInArrow(run, _schema(bands)), size, bands)


def windowed(tiles: Tiles, row0: int, row1: int, col0: int, col1: int) -> Tiles:
    """Pixels of rows ``row0`` to ``row1`` and columns ``col0`` to ``col1``, ends included; other tiles are not read."""
    size = tiles.size
    rows = tiles.rows.filter(F.col("tile_r").between(row0 // size, row1 // size) & F.col("tile_c").between(col0 // size, col1 // size))

    def keep(t: dict) -> np.ndarray:
        r, c = np.arange(size) + t["tile_r"] * size, np.arange(size) + t["tile_c"] * size
        return _mask(t["here"], size) & ((r >= row0) & (r <= row1))[:, None] & ((c >= col0) & (c <= col1))

    return _masked(tiles, rows, keep)


def shifted(tiles: Tiles, rows: int, cols: int) -> Tiles:
    """Tiles of the same raster with its origin moved by whole pixels: each tile is cut into at most four, which are put together by place."""
    size, bands = tiles.size, tiles.bands
    (down, r), (right, c) = divmod(rows, size), divmod(cols, size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                planes = {x: _mask(t[x], size) if x == "here" or x.endswith("_ok") and x[:-3] in bands else np.frombuffer(t[x], KINDS[bands[x]]).reshape(size, size) for x in _columns(bands)}
                parts = []
                for dr in (0, 1) if r else (0,):
                    for dc in (0, 1) if c else (0,):
                        to_r, to_c = slice(r, size) if not dr else slice(0, r), slice(c, size) if not dc else slice(0, c)
                        from_r, from_c = slice(0, size - r) if not dr else slice(size - r, size), slice(0, size - c) if not dc else slice(size - c, size)
                        if planes["here"][from_r, from_c].any():
                            out = {}
                            for x, plane in planes.items():
                                moved = np.zeros_like(plane)
                                moved[to_r, to_c] = plane[from_r, from_c]
                                out[x] = _bits(moved) if moved.dtype == bool else moved.tobytes()
                            parts.append((t["tile_r"] + down + dr, t["tile_c"] + right + dc, out))
                if parts:
                    yield _batch(parts, bands)

    def put(key: tuple, t: pa.Table) -> pa.Table:
        # parts don't overlap and are zero elsewhere
        out = {x: reduce(lambda a, b: a | b, (np.frombuffer(v.as_py(), np.uint8) for v in t[x])).tobytes() for x in _columns(bands)}
        return pa.Table.from_batches([_batch([(key[0].as_py(), key[1].as_py(), out)], bands)])

    moved = tiles.rows.mapInArrow(cut, _schema(bands))
    return Tiles(moved.groupBy("tile_r", "tile_c").applyInArrow(put, _schema(bands)) if r or c else moved, size, bands)


def stacked(first: Tiles, *others: Tiles) -> Tiles:
    """Bands of rasters side by side, where all have a pixel: a join of tiles by their place. Band names are distinct."""
    rows, bands, marks = first.rows, dict(first.bands), ["here"]
    for k, o in enumerate(others):
        if o.size != first.size or set(o.bands) & set(bands):
            raise ValueError("rasters of a stack have tiles of one size and bands of different names")
        rows, bands, marks = rows.join(o.rows.withColumnRenamed("here", f"_here{k}"), ["tile_r", "tile_c"]), bands | o.bands, [*marks, f"_here{k}"]
    size = first.size
    return _masked(Tiles(rows, size, bands), rows, lambda t: reduce(np.logical_and, (_mask(t[m], size) for m in marks)))


def stored(tiles: Tiles, path: str) -> None:
    """Tiles as a Parquet table, with the grid in the name of its folder."""
    tiles.rows.write.parquet(f"{path}/size={tiles.size}")


def opened(spark: SparkSession, path: str, size: int, bands: dict[str, str]) -> Tiles:
    """Tiles that ``stored`` has left; bands that are not asked for are not read."""
    return Tiles(spark.read.schema(_schema(bands)).parquet(f"{path}/size={size}"), size, bands)
