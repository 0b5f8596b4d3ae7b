"""Polygons as arrays of rings, and pixels or cells inside them.

A feature has ``rings``: an array of closed or open rings, each an array of
points with x and y; the first is the outline, the others are holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.operators import sides as S


def ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace formula, without a sign."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2


def polygon_area(rings: str = "rings") -> dict[str, Column]:
    """Area without holes in four units."""
    outline = ring_area(F.col(rings)[0])
    holes = F.aggregate(F.slice(F.col(rings), F.lit(2), F.size(rings)), F.lit(0.0), lambda a, r: a + ring_area(r))
    m2 = outline - holes
    return {"area_m2": m2, "area_km2": m2 / 1e6, "area_ha": m2 / 1e4, "area_acre": m2 / 4046.8564224}


def bounds(rings: str = "rings") -> dict[str, Column]:
    """Bounds of a feature's outline."""
    xs, ys = F.transform(F.col(rings)[0], lambda p: p["x"]), F.transform(F.col(rings)[0], lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def extent(features: DataFrame) -> DataFrame:
    """Extent of a layer."""
    b = features.select(*(v.alias(k) for k, v in bounds().items()))
    return b.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def fingerprint(shape: str) -> Column:
    """Key of a geometry's bytes."""
    return F.sha1(shape)


def edges(features: DataFrame, rings: str = "rings") -> DataFrame:
    """Sides of all rings, one row each, the lower end first."""
    e = features.select("feature_id", F.explode(rings).alias("r"))
    nxt = F.concat(F.slice("r", F.lit(2), F.size("r")), F.slice("r", 1, 1))
    e = e.select("feature_id", F.explode(F.arrays_zip(F.col("r").alias("p"), nxt.alias("q"))).alias("e")).select("feature_id", "e.*")
    return e.filter("p <> q").select("feature_id", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))


def dissolved_edges(features: DataFrame) -> DataFrame:
    """Sides of the outer boundary of features that share vertices: those that only one has."""
    return edges(features).groupBy("p", "q").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"))


def crossed(x: Column, y: Column, sides: Column) -> Column:
    """Number of ``sides`` (p, q) that a ray from a point towards greater x crosses."""
    return F.size(F.filter(sides, lambda s: ((s["p"]["y"] > y) != (s["q"]["y"] > y)) & (x < meeting(y, s))))


def meeting(y: Column, s: Column) -> Column:
    """Where a side meets a height that it crosses."""
    p, q = s["p"], s["q"]
    return p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])


def sides(rings: str = "rings") -> Column:
    """Sides of all rings of a polygon as an array of (p, q)."""

    def of(r: Column) -> Column:
        nxt = F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, 1, 1))
        return F.zip_with(r, nxt, lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    return F.flatten(F.transform(rings, of))


def shares_surface(rings: str, x0: str, y0: str, x1: str, y1: str) -> Column:
    """Whether a polygon and a rectangle overlap in more than an edge: a side runs through the rectangle, or its centre is inside."""

    def part(a: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        t0, t1 = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        within = (a > lo) & (a < hi)
        return F.coalesce(F.least(t0, t1), F.when(within, 0.0), F.lit(2.0)), F.coalesce(F.greatest(t0, t1), F.when(within, 1.0), F.lit(-1.0))

    def through(s: Column) -> Column:
        a = part(s["p"]["x"], s["q"]["x"] - s["p"]["x"], F.col(x0), F.col(x1))
        b = part(s["p"]["y"], s["q"]["y"] - s["p"]["y"], F.col(y0), F.col(y1))
        return F.greatest(a[0], b[0], F.lit(0.0)) < F.least(a[1], b[1], F.lit(1.0))

    centre = crossed((F.col(x0) + F.col(x1)) / 2, (F.col(y0) + F.col(y1)) / 2, sides(rings))
    return F.exists(sides(rings), through) | (centre % 2 == 1)


def pixels_in(pixels: DataFrame, features: DataFrame, cell: float, how: str = "inner") -> DataFrame:
    """Pairs of a pixel (x, y) and a feature that holds its centre.

    Sides are cut into square cells, and cells with many sides into finer ones;
    pixels join by the cell they are in, so the plan is a hash join whose rest
    is the exact test on a few sides, however many a feature has.  With ``how``
    "left_semi" (A06) each pixel of the region comes once, without a feature.
    """
    return S.points_in(pixels, features, cell, how)


def zone_of_pixels(pixels: DataFrame, zones: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """One zone per pixel, that of the later shape; pixels outside all zones are left out."""
    return pixels_in(pixels, zones, cell).groupBy(*keys).agg(F.max("feature_id").alias("feature_id"))


def burned(features: DataFrame, step: float) -> DataFrame:
    """Cells of a grid snapped to ``step`` whose centres a labelled feature holds; the later feature wins.

    Each row of cells is filled between the sides that cross its middle, so no
    cell outside a feature is made.  A class that is none of the ten raises.
    """
    shapes = S.keyed(features)
    ok = F.when(F.col("class_id").between(1, 10), F.col("class_id")).otherwise(F.raise_error(F.lit("class is none of the ten")).cast("int"))
    cells = S.with_features(S.filled(S.side_rows(shapes.select("_key", "rings")), step), shapes.select("_key", "feature_id", "class_id"))
    return cells.groupBy("cx", "cy").agg(F.max_by(ok, "feature_id").alias("class_id"))


def touched(features: DataFrame, step: float) -> DataFrame:
    """Cells that a feature touches: those with their centre in it, or a side through them.

    Each row of cells is filled as in G24 and each of its sides adds the cells
    along it, so the work is that of the cells found and not of the bounds.
    """
    box, shapes = bounds(), S.keyed(features)
    edge = {"_cx0": F.floor(box["minx"] / step), "_maxx": F.ceil(box["maxx"] / step) - 1, "_cy0": F.floor(box["miny"] / step), "_maxy": F.ceil(box["maxy"] / step) - 1}
    s = S.side_rows(shapes.select("_key", "rings"))
    cells = S.with_features(S.filled(s, step).unionByName(S.along(s, step)).distinct(), shapes.withColumns(edge).select("_key", "feature_id", *edge))
    return cells.filter(F.col("cx").between(F.col("_cx0"), F.col("_maxx")) & F.col("cy").between(F.col("_cy0"), F.col("_maxy"))).select("feature_id", "cx", "cy")


def sound_features(features: DataFrame) -> DataFrame:
    """Features with a geometry; a null or empty one is left out."""
    return features.filter(F.col("rings").isNotNull() & (F.size("rings") > 0) & (F.size(F.col("rings")[0]) >= 3))


def rectangle(x0, y0, x1, y1) -> Column:
    """Rings of a rectangle."""
    return F.array(F.array(*(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)))))


def to_utm(lon: Column, lat: Column, zone: int = 46) -> dict[str, Column]:
    """Geographic degrees (WGS 84) to metres of a northern UTM zone, by the sixth-order series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t, c, aa = F.tan(phi) ** 2, ep2 * F.cos(phi) ** 2, F.cos(phi) * lam
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    x = 500000.0 + k0 * n * (aa + (1 - t + c) * aa**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * aa**5 / 120)
    y = k0 * (m + n * F.tan(phi) * (aa**2 / 2 + (5 - t + 9 * c + 4 * c**2) * aa**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * aa**6 / 720))
    return {"easting": x, "northing": y}


def from_utm(easting: Column, northing: Column, zone: int = 46) -> dict[str, Column]:
    """Metres of a northern UTM zone to geographic degrees."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    mu = northing / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s2 = F.sin(p) ** 2
    c, t, n = ep2 * F.cos(p) ** 2, F.tan(p) ** 2, a / F.sqrt(1 - e2 * s2)
    r, d = a * (1 - e2) / (1 - e2 * s2) ** 1.5, (easting - 500000.0) / (n * k0)
    lat = p - (n * F.tan(p) / r) * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep2 - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep2 + 24 * t**2) * d**5 / 120) / F.cos(p)
    return {"lon": F.degrees(lon) + (zone * 6 - 183), "lat": F.degrees(lat)}
