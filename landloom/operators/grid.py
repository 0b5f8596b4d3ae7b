"""Raster grids: pixel and world coordinates, blocks, tiles and their checks.

A grid is a row with epsg, the affine numbers a, c, e, f (no rotation), width
and height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.operators.vector import shares_surface

from landloom.functions.names import block_name

KM_PER_DEGREE = 111.32


def to_world(pixels: DataFrame) -> DataFrame:
    """X and y of pixel centres; ``pixels`` has px_row, px_col and the grid's numbers."""
    return pixels.withColumns({"x": F.col("c") + F.col("a") * (F.col("px_col") + 0.5), "y": F.col("f") + F.col("e") * (F.col("px_row") + 0.5)})


def to_pixel(points: DataFrame) -> DataFrame:
    """Pixel that holds a point."""
    return points.withColumns({"px_col": F.floor((F.col("x") - F.col("c")) / F.col("a")), "px_row": F.floor((F.col("y") - F.col("f")) / F.col("e"))})


def overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Window of grid ``one`` that grid ``two`` covers, for grids joined by their epsg; none if they don't meet."""
    a, b = one.alias("p"), two.alias("q")

    def edge(t: str, k: str) -> Column:
        side = {"left": "c", "right": "c", "top": "f", "bottom": "f"}[k]
        step = {"left": F.lit(0), "right": F.col(f"{t}.width") * F.col(f"{t}.a"), "top": F.lit(0), "bottom": F.col(f"{t}.height") * F.col(f"{t}.e")}[k]
        return F.col(f"{t}.{side}") + step

    left, right = F.greatest(edge("p", "left"), edge("q", "left")), F.least(edge("p", "right"), edge("q", "right"))
    top, bottom = F.least(edge("p", "top"), edge("q", "top")), F.greatest(edge("p", "bottom"), edge("q", "bottom"))
    col = F.floor((left - F.col("p.c")) / F.col("p.a") + 0.5)
    row = F.floor((top - F.col("p.f")) / F.col("p.e") + 0.5)
    out = a.join(b, F.col("p.epsg") == F.col("q.epsg")).filter((right > left) & (top > bottom))
    return out.select(
        F.col("p.grid_id").alias("grid_a"),
        F.col("q.grid_id").alias("grid_b"),
        col.alias("col_off"),
        row.alias("row_off"),
        F.least(F.floor((right - left) / F.col("p.a") + 0.5), F.col("p.width") - col).alias("n_cols"),
        F.least(F.floor((bottom - top) / F.col("p.e") + 0.5), F.col("p.height") - row).alias("n_rows"),
    )


def snapped(bounds: DataFrame, step: float) -> DataFrame:
    """Bounds minx, miny, maxx, maxy moved outward to multiples of ``step``."""
    out = {c: F.floor(F.col(c) / step) * step for c in ("minx", "miny")} | {c: F.ceil(F.col(c) / step) * step for c in ("maxx", "maxy")}
    return bounds.withColumns(out)


def same_grid(tolerance: float, one: str = "p", two: str = "q") -> Column:
    """Whether two aliased grids agree within a tolerance."""
    same = F.lit(True)
    for c in ("epsg", "width", "height"):
        same = same & (F.col(f"{one}.{c}") == F.col(f"{two}.{c}"))
    for c in ("a", "c", "e", "f"):
        same = same & (F.abs(F.col(f"{one}.{c}") - F.col(f"{two}.{c}")) <= tolerance)
    return same


def with_blocks(pixels: DataFrame, block_px: int) -> DataFrame:
    """Block row, column and name; ``pixels`` has area."""
    out = pixels.withColumns({"block_row": F.expr(f"px_row div {block_px}"), "block_col": F.expr(f"px_col div {block_px}")})
    return out.withColumn("block_id", block_name("area", "block_row", "block_col"))


def block_fraction(seed: int) -> Column:
    """Number in [0, 1) that a block's place and a seed decide."""
    # Multipliers of the hash.
    mixed = (F.col("block_row").cast("long") * 73856093).bitwiseXOR(F.col("block_col").cast("long") * 19349663).bitwiseXOR(F.lit(seed).cast("long") * 83492791)
    return (mixed % 10_000_000) / 10_000_000.0


def pixel_area(geographic: tuple[int, ...] = (4326,)) -> dict[str, Column]:
    """Area of a pixel in three units, null on grids in degrees."""
    m2 = F.when(~F.col("epsg").isin(*geographic), F.abs(F.col("a") * F.col("e")))
    return {"area_m2": m2, "area_ha": m2 / 1e4, "area_km2": m2 / 1e6}


def degrees(km: float, latitude) -> dict[str, Column]:
    """A distance in degrees of latitude and of longitude at a latitude."""
    return {"deg_lat": F.lit(km / KM_PER_DEGREE), "deg_lon": F.lit(km) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(latitude)))}


def corner_bounds(corners: str) -> dict[str, Column]:
    """Bounds of a polygon given as an array of points with x and y."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def overlapping_tiles(areas: DataFrame, width_km: float, height_km: float, overlap_km: float) -> DataFrame:
    """Tiles of a size in km, each overlapping the next, over the bounds of each area.

    Steps are in degrees at the middle latitude; tiles end at the bounds, and
    those that only touch the area's edge are left out.  If areas have ``rings``,
    tiles that share no surface with that polygon are left out too.
    """
    mid = (F.col("miny") + F.col("maxy")) / 2
    w, h = degrees(width_km, mid)["deg_lon"], degrees(height_km, mid)["deg_lat"]
    step_x, step_y = degrees(width_km - overlap_km, mid)["deg_lon"], degrees(height_km - overlap_km, mid)["deg_lat"]
    out = areas.withColumns({"_w": w, "_h": h, "_sx": step_x, "_sy": step_y})
    out = out.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.ceil((F.col("maxy") - F.col("miny")) / F.col("_sy")).cast("int") - 1)))
    out = out.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.ceil((F.col("maxx") - F.col("minx")) / F.col("_sx")).cast("int") - 1)))
    x, y = F.col("minx") + F.col("tile_col") * F.col("_sx"), F.col("miny") + F.col("tile_row") * F.col("_sy")
    out = out.withColumns({"tile_x0": x, "tile_y0": y, "tile_x1": F.least(x + F.col("_w"), "maxx"), "tile_y1": F.least(y + F.col("_h"), "maxy")})
    out = out.filter((F.col("tile_x0") < F.col("maxx")) & (F.col("tile_y0") < F.col("maxy"))).drop("_w", "_h", "_sx", "_sy")
    return out.filter(shares_surface("rings", "tile_x0", "tile_y0", "tile_x1", "tile_y1")) if "rings" in areas.columns else out


def degree_tiles(areas: DataFrame, step: float) -> DataFrame:
    """Tiles of fixed degrees over each area, the last ones clipped."""
    out = areas
    for axis, lo, hi in (("row", "miny", "maxy"), ("col", "minx", "maxx")):
        out = out.withColumn(f"tile_{axis}", F.explode(F.sequence(F.lit(0), F.ceil((F.col(hi) - F.col(lo)) / step).cast("int") - 1)))
    x, y = F.col("minx") + F.col("tile_col") * step, F.col("miny") + F.col("tile_row") * step
    return out.withColumns({"tile_x0": x, "tile_y0": y, "tile_x1": F.least(x + step, F.col("maxx")), "tile_y1": F.least(y + step, F.col("maxy"))})


def named_tile_bounds(name: str) -> dict[str, Column]:
    """Bounds of a one-degree tile from a name such as N23E090."""
    def part(k: int) -> Column:
        return F.regexp_extract(name, r"([NS])(\d{2})([EW])(\d{3})", k)

    lat = part(2).cast("int") * F.when(part(1) == "S", -1).otherwise(1)
    lon = part(4).cast("int") * F.when(part(3) == "W", -1).otherwise(1)
    return {"tile_x0": lon, "tile_y0": lat, "tile_x1": lon + 1, "tile_y1": lat + 1}


def meets(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether a tile shares more than an edge with a rectangle."""
    return (F.col("tile_x0") < x1) & (F.col("tile_x1") > x0) & (F.col("tile_y0") < y1) & (F.col("tile_y1") > y0)


def mosaic_extent(grids: DataFrame) -> DataFrame:
    """Extent and shape of a mosaic of grids; raises if their systems or pixel sizes differ."""
    out = grids.agg(
        F.min("c").alias("left"),
        F.max("f").alias("top"),
        F.max(F.col("c") + F.col("width") * F.col("a")).alias("right"),
        F.min(F.col("f") + F.col("height") * F.col("e")).alias("bottom"),
        F.first("a").alias("a"),
        F.first("e").alias("e"),
        (F.max(F.struct("epsg", "a", "e")) == F.min(F.struct("epsg", "a", "e"))).alias("_same"),
    )
    width = F.ceil((F.col("right") - F.col("left")) / F.col("a") - 1e-9)
    checked = F.when(F.col("_same"), width).otherwise(F.raise_error(F.lit("tiles differ in system or pixel size")).cast("long"))
    return out.select("left", "top", "right", "bottom", checked.alias("width"), F.ceil((F.col("bottom") - F.col("top")) / F.col("e") - 1e-9).alias("height"))


def blocks_in_window(blocks: DataFrame, block_px: int, row0: int, col0: int, rows: int, cols: int, context: int) -> DataFrame:
    """Rectangles of the blocks that meet a window or lie within ``context`` blocks of it, relative to it."""
    near = (F.col("block_row") >= row0 // block_px - context) & (F.col("block_row") <= (row0 + rows - 1) // block_px + context)
    near &= (F.col("block_col") >= col0 // block_px - context) & (F.col("block_col") <= (col0 + cols - 1) // block_px + context)
    return blocks.filter(near).withColumns({"top": F.col("block_row") * block_px - row0, "left": F.col("block_col") * block_px - col0, "side": F.lit(block_px)})


def grid_report(grids: DataFrame, reference: str, tolerance: float = 1e-9) -> DataFrame:
    """Each grid held against a reference grid, one column per property, and ready if all agree."""
    ref = grids.filter(F.col("grid_id") == reference).alias("q")  # one row
    checks = {f"same_{c}": F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("epsg", "width", "height")}
    checks["same_transform"] = (F.abs(F.col("p.a") - F.col("q.a")) <= tolerance) & (F.abs(F.col("p.c") - F.col("q.c")) <= tolerance) & (F.abs(F.col("p.e") - F.col("q.e")) <= tolerance) & (F.abs(F.col("p.f") - F.col("q.f")) <= tolerance)
    out = grids.alias("p").join(F.broadcast(ref), how="cross").select("p.grid_id", *(v.alias(k) for k, v in checks.items()))
    ready = F.lit(True)
    for k in checks:
        ready = ready & F.col(k)
    return out.withColumn("ready", ready)


def require_ready(report: DataFrame) -> DataFrame:
    """The report, or an error for a grid that isn't ready."""
    return report.withColumn("ready", F.when(F.col("ready"), True).otherwise(F.raise_error(F.concat(F.lit("grid not ready: "), F.col("grid_id"))).cast("boolean")))
