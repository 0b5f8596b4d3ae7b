"""Queries of rasters and of composites over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.functions import indices as I
from landloom.operators import raster as R
from landloom.operators import tiles as L
from landloom.operators import vector as V
from landloom.queries import query
from landloom.queries.accuracy import rounded
from landloom.sources.derived import table
from landloom.sources.shared import folder

T = "{{tiles}}"
MOSAIC = f"SELECT px_row, px_col, value FROM (SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY {{order}}) AS r FROM {T}) WHERE r = 1"


@query(MOSAIC.format(order="tile DESC"))
def g28_mosaic_last(spark, d):
    return R.mosaic(table(spark, d, "tiles"), "last")


@query(MOSAIC.format(order="value IS NULL, tile DESC"))
def g29_mosaic_last_valid(spark, d):
    return R.mosaic(table(spark, d, "tiles"), "last_valid")


@query(MOSAIC.format(order="value IS NULL, tile"))
def g30_mosaic_first_valid(spark, d):
    return R.mosaic(table(spark, d, "tiles"), "first_valid")


@query("""WITH m AS (SELECT px_row, px_col, z FROM {dem}) SELECT a.px_row, a.px_col, coalesce(a.z, (SELECT b.z FROM m b WHERE b.z IS NOT NULL AND abs(a.px_row - b.px_row) <= 1 AND abs(a.px_col - b.px_col) <= 1
 ORDER BY (a.px_row - b.px_row) ** 2 + (a.px_col - b.px_col) ** 2, a.px_row - b.px_row, a.px_col - b.px_col LIMIT 1)) AS z FROM m a""")
def g32_filled_seams(spark, d):
    return R.filled_seams(table(spark, d, "dem"), "z")


@query("SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_suppkey % 50 IN (7, 8) OR l_suppkey % 50 = 0 THEN NULL ELSE CAST(l_suppkey % 50 AS INT) END AS value FROM {lineitem}")
def g33_one_nodata(spark, d):
    v = (F.col("l_suppkey") % 50).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", R.one_nodata(v, [0, 7, 8]).alias("value"))


@query("SELECT sample_id, ae[1] AS b1 FROM {ae_pixels}")
def g34_float_bands(spark, d):
    return table(spark, d, "ae_pixels").select("sample_id", R.float_band("ae", 0).alias("b1"))


def coarse(spark, d):
    return table(spark, d, "ae_pixels").select("px_row", "px_col", F.when((F.expr("px_row div 5") + F.expr("px_col div 5")) % 2 == 0, 1).otherwise(2).alias("class_id"))


_CHECKER = "(SELECT px_row, px_col, CASE WHEN (px_row // 5 + px_col // 5) % 2 = 0 THEN 1 ELSE 2 END AS class_id FROM {ae_pixels})"


@query(f"SELECT a.px_row, a.px_col, a.class_id FROM {_CHECKER} a JOIN {_CHECKER} b ON abs(a.px_row - b.px_row) <= 1 AND abs(a.px_col - b.px_col) <= 1 AND a.class_id = b.class_id GROUP BY ALL HAVING count(*) = 9")
def g36_interior_pixels(spark, d):
    return R.interior(coarse(spark, d), 1)


_SL = "CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0 ELSE (coalesce({b}, z) - coalesce({a}, z)) / (CASE WHEN {a} IS NULL THEN 0 ELSE 1 END + CASE WHEN {b} IS NULL THEN 0 ELSE 1 END) END"


@query(f"""SELECT px_row, px_col, round(least(greatest((sin(radians(45)) * sin(pi() / 2 - atan(sqrt(x * x + y * y))) + cos(radians(45)) * cos(pi() / 2 - atan(sqrt(x * x + y * y))) * cos(radians(315) - atan2(-x, y)) + 1) / 2, 0), 1), 6) AS shade
 FROM (SELECT px_row, px_col, {_SL.format(a="up", b="down")} AS x, {_SL.format(a="lef", b="rig")} AS y FROM (SELECT m.*, u.z AS up, w.z AS down, l.z AS lef, r.z AS rig FROM {{dem}} m
 LEFT JOIN {{dem}} u ON u.px_row = m.px_row - 1 AND u.px_col = m.px_col LEFT JOIN {{dem}} w ON w.px_row = m.px_row + 1 AND w.px_col = m.px_col
 LEFT JOIN {{dem}} l ON l.px_col = m.px_col - 1 AND l.px_row = m.px_row LEFT JOIN {{dem}} r ON r.px_col = m.px_col + 1 AND r.px_row = m.px_row WHERE m.z IS NOT NULL))""")
def g38_hillshade(spark, d):
    return rounded(R.hillshade(table(spark, d, "dem")), "shade")


TARGET = "(SELECT px_row, px_col, (px_col + 0.5) * 0.5::DOUBLE AS u, (px_row + 0.5) * 0.5::DOUBLE AS v FROM (SELECT px_row * 2 + a AS px_row, px_col * 2 + b AS px_col FROM {ae_pixels}, range(0, 2) x(a), range(0, 2) y(b)))"


def fine(spark, d):
    p = table(spark, d, "ae_pixels").select(F.explode(F.array(*(F.struct((F.col("px_row") * 2 + a).alias("px_row"), (F.col("px_col") * 2 + b).alias("px_col")) for a in (0, 1) for b in (0, 1)))).alias("x")).select("x.*")
    return p.withColumns({"u": (F.col("px_col") + 0.5) * 0.5, "v": (F.col("px_row") + 0.5) * 0.5})


@query(f"SELECT t.px_row, t.px_col, s.z FROM {TARGET} t LEFT JOIN {{dem}} s ON s.px_row = floor(t.v) AND s.px_col = floor(t.u)")
def g15_warp_nearest(spark, d):
    return R.warped(table(spark, d, "dem"), fine(spark, d), "nearest", "z")


@query(f"""SELECT t.px_row, t.px_col, round(sum(s.z * w) / sum(w) FILTER (s.z IS NOT NULL), 6) AS z FROM (SELECT px_row, px_col, floor(v - 0.5) + a AS r, floor(u - 0.5) + b AS c,
 (CASE WHEN a = 1 THEN v - 0.5 - floor(v - 0.5) ELSE 1 - (v - 0.5 - floor(v - 0.5)) END) * (CASE WHEN b = 1 THEN u - 0.5 - floor(u - 0.5) ELSE 1 - (u - 0.5 - floor(u - 0.5)) END) AS w FROM {TARGET}, range(0, 2) x(a), range(0, 2) y(b)) t
 LEFT JOIN {{dem}} s ON s.px_row = t.r AND s.px_col = t.c GROUP BY ALL""")
def g15_g41_warp_bilinear(spark, d):
    return rounded(R.warped(table(spark, d, "dem"), fine(spark, d), "bilinear", "z"), "z")


def kernel_sql(weight: str, half: int) -> str:
    """Warp of {dem} onto the finer grid; ``weight`` is the kernel at a distance d in pixels."""
    w = [f"({weight.replace('%d', f'abs({p} - 0.5 - {k})')})" for p, k in (("v", "r"), ("u", "c"))]
    taps = f"SELECT px_row, px_col, u, v, floor(v - 0.5) + a AS r, floor(u - 0.5) + b AS c FROM {TARGET}, range({1 - half}, {half + 1}) x(a), range({1 - half}, {half + 1}) y(b)"
    return f"""SELECT px_row, px_col, round(CASE WHEN abs(k) >= 1e-6 THEN zk / k END, 6) AS z FROM (SELECT t.px_row, t.px_col, sum(z * w) AS zk, sum(w) FILTER (z IS NOT NULL) AS k
 FROM (SELECT *, {w[0]} * {w[1]} AS w FROM ({taps})) t LEFT JOIN {{dem}} s ON s.px_row = t.r AND s.px_col = t.c GROUP BY 1, 2)"""


@query(kernel_sql("CASE WHEN %d < 1 THEN 1.5 * %d ** 3 - 2.5 * %d ** 2 + 1 WHEN %d < 2 THEN -0.5 * %d ** 3 + 2.5 * %d ** 2 - 4 * %d + 2 ELSE 0 END", 2))
def g15_warp_cubic(spark, d):
    return rounded(R.warped(table(spark, d, "dem"), fine(spark, d), "cubic", "z"), "z")


@query(kernel_sql("CASE WHEN %d < 1 THEN 2 / 3 - %d ** 2 + %d ** 3 / 2 WHEN %d < 2 THEN (2 - %d) ** 3 / 6 ELSE 0 END", 2))
def g16_warp_cubic_spline(spark, d):
    return rounded(R.warped(table(spark, d, "dem"), fine(spark, d), "cubicspline", "z"), "z")


@query(kernel_sql("CASE WHEN %d = 0 THEN 1 WHEN %d < 3 THEN sin(pi() * %d) / (pi() * %d) * sin(pi() * %d / 3) / (pi() * %d / 3) ELSE 0 END", 3))
def g16_warp_lanczos(spark, d):
    return rounded(R.warped(table(spark, d, "dem"), fine(spark, d), "lanczos", "z"), "z")


@query("SELECT px_row // 3 AS px_row, px_col // 3 AS px_col, round(avg(z), 6) AS z FROM {dem} GROUP BY 1, 2")
def g16_warp_average(spark, d):
    s = table(spark, d, "dem").withColumns({"t_row": F.expr("px_row div 3"), "t_col": F.expr("px_col div 3")})
    target = s.select(F.col("t_row").alias("px_row"), F.col("t_col").alias("px_col")).distinct()
    return rounded(R.warped(s, target, "average", "z"), "z")


@query("SELECT px_row // 3 AS px_row, px_col // 3 AS px_col, z FROM {dem} WHERE px_row % 3 = 1 AND px_col % 3 = 1")
def g17_downsampled(spark, d):
    return R.downsampled(table(spark, d, "dem"), 20, 25, 10)


IN = "EXISTS (SELECT 1 FROM {zones} z WHERE px_col + 0.5 > z.x0 AND px_col + 0.5 < z.x1 AND px_row + 0.5 > z.y0 AND px_row + 0.5 < z.y1 AND z.region = 1)"


def placed(spark, d):
    return table(spark, d, "dem").withColumns({"x": F.col("px_col") + 0.5, "y": F.col("px_row") + 0.5})


def region(spark, d):
    z = table(spark, d, "zones").filter("region = 1")
    return z.select(F.col("zone_id").alias("feature_id"), V.rectangle("x0", "y0", "x1", "y1").alias("rings"))


@query(f"SELECT px_row, px_col, z FROM {{dem}} WHERE {IN}")
def g26_clipped(spark, d):
    return R.clipped(placed(spark, d), region(spark, d), 4.0).select("px_row", "px_col", "z")


@query(f"SELECT px_row // 3 AS px_row, px_col // 3 AS px_col, round(avg(z), 6) AS z FROM {{dem}} WHERE {IN} GROUP BY 1, 2")
def g27_clipped_and_warped(spark, d):
    s = R.clipped(placed(spark, d), region(spark, d), 4.0).withColumns({"t_row": F.expr("px_row div 3"), "t_col": F.expr("px_col div 3")})
    target = s.select(F.col("t_row").alias("px_row"), F.col("t_col").alias("px_col")).distinct()
    return rounded(R.warped(s, target, "average", "z"), "z")


def metric_cells(pixels, step: float = 1000.0):
    """Cells of a UTM grid that hold a pixel's centre, with their own centres as places of a grid of 0.01 degrees."""
    m = V.to_utm(90.0 + F.col("x") * 0.01, 24.0 - F.col("y") * 0.01)
    cells = pixels.select(F.floor(m["northing"] / step).alias("px_row"), F.floor(m["easting"] / step).alias("px_col")).distinct()
    back = V.from_utm((F.col("px_col") + 0.5) * step, (F.col("px_row") + 0.5) * step)
    return cells.withColumns({"u": (back["lon"] - 90.0) / 0.01, "v": (24.0 - back["lat"]) / 0.01})


@query()
def g27_clipped_to_utm(spark, d):
    p = placed(spark, d)
    return rounded(R.clipped_and_warped(p, region(spark, d), 4.0, metric_cells(p), "bilinear", "z"), "z")


@query("SELECT min(px_row) AS row0, max(px_row) AS row1, min(px_col) AS col0, max(px_col) AS col1 FROM {dem} WHERE z IS NOT NULL")
def g39_valid_extent(spark, d):
    return R.valid_extent(table(spark, d, "dem"), "z")


@query("SELECT px_row, px_col FROM {dem} WHERE px_col + 0.5 BETWEEN 3.0 AND 12.5 AND px_row + 0.5 BETWEEN 3.5 AND 9.0")
def g40_buffered_window(spark, d):
    return R.within_buffer(placed(spark, d), 5.0, 4.5, 10.0, 8.0, (2.0, 1.0, 2.5, 1.0)).select("px_row", "px_col")


@query("SELECT min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n_valid, count(*) - count(v) AS n_missing, round(count(v) / count(*), 9) AS valid_share FROM (SELECT nullif(b8, 65535)::DOUBLE AS v FROM {band_pixels})")
def a33_raster_statistics(spark, d):
    s = R.statistics(table(spark, d, "band_pixels").select(I.dn("b8").alias("v")), "v")
    return rounded(rounded(s, "mean", "std"), "valid_share", digits=9)


@query("SELECT round(count(*) FILTER (b2 <> 65535) * 100.0 / count(*), 6) AS pct_valid, round(count(*) FILTER (b2 = 65535) * 100.0 / count(*), 6) AS pct_missing FROM {band_pixels}")
def a50_coverage(spark, d):
    b = table(spark, d, "band_pixels").select(*(I.dn(c).alias(c) for c in ("b2", "b3", "b4")))
    return rounded(R.coverage(b, ["b2", "b3", "b4"]), "pct_valid", "pct_missing")


OB = "{observations}"


@query(f"SELECT pixel, band, median(dn)::DOUBLE AS dn FROM {OB} WHERE (qa IS NULL OR qa >= 0.6) AND ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2")
def a41_median_composite(spark, d):
    keep = (F.col("qa").isNull() | (F.col("qa") >= 0.6)) & (F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    return R.median_composite(table(spark, d, "observations"), keep)


@query(f"SELECT pixel, band, coalesce(median(dn) FILTER (ts < TIMESTAMP '2024-01-04' AND qa >= 0.6), median(dn) FILTER (ts >= TIMESTAMP '2024-01-25'), 65535)::DOUBLE AS dn FROM {OB} GROUP BY 1, 2")
def a42_gap_filled(spark, d):
    first = (F.col("ts") < F.lit("2024-01-04").cast("timestamp")) & (F.col("qa") >= 0.6)
    return R.gap_filled(table(spark, d, "observations"), first, F.col("ts") >= F.lit("2024-01-25").cast("timestamp"), 65535)


@query(f"SELECT pixel, class_id FROM (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY n DESC, class_id) AS r FROM (SELECT pixel, dn % 10 AS class_id, count(*) AS n FROM {OB} GROUP BY 1, 2)) WHERE r = 1")
def a43_mode_composite(spark, d):
    return R.mode_composite(table(spark, d, "observations").withColumn("class_id", F.col("dn") % 10), ["pixel"], "class_id")


@query(f"SELECT a.scene, a.pixel, b.qa::DOUBLE AS score FROM {OB} a LEFT JOIN (SELECT scene, qa FROM {OB} WHERE qa >= 0.5) b USING (scene)")
def j13_linked_scores(spark, d):
    o = table(spark, d, "observations")
    return R.linked(o.select("scene", "pixel"), o.filter("qa >= 0.5").select("scene", F.col("qa").cast("double").alias("score")))


_OFF = "CAST(abs(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-15 12:00:00') // 1000) AS BIGINT)"


@query(f"SELECT scene, {_OFF} AS off_ms FROM {OB} ORDER BY off_ms, scene LIMIT 20")
def t05_nearest_scenes(spark, d):
    return R.nearest_scenes(table(spark, d, "observations"), "2024-01-15 12:00:00", 20).select("scene", "off_ms")


@query(f"SELECT pixel, band, dn FROM (SELECT *, row_number() OVER (PARTITION BY pixel, band ORDER BY {_OFF}, scene) AS r FROM {OB}) WHERE r = 1")
def t05_nearest_per_pixel(spark, d):
    return R.nearest_per_pixel(table(spark, d, "observations"), "2024-01-15 12:00:00")


@query(f"SELECT pixel, band, arg_max(dn, ts) FILTER (qa IS NOT NULL) AS dn FROM {OB} WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2")
def t06_same_day_mosaic(spark, d):
    return R.same_day_mosaic(table(spark, d, "observations"), "2024-01-15")


@query("SELECT px_row, px_col FROM {ae_pixels} WHERE NOT (px_col < 15 AND sample_id % 5 <> 0)")
def j10_j11_missing_tiles(spark, d):
    present = table(spark, d, "tiles").filter("tile = 0 and value is not null")
    return R.missing(table(spark, d, "ae_pixels").select("px_row", "px_col"), present, ["px_row", "px_col"])


@query("SELECT a.px_row, a.px_col, a.class_id, d.z FROM {ae_pixels} a JOIN {dem} d ON d.px_row = a.px_row AND d.px_col = a.px_col")
def j01_s02_aligned_stack(spark, d):
    p = table(spark, d, "ae_pixels")
    return R.aligned(p.select("px_row", "px_col", "class_id"), [table(spark, d, "dem"), p.select("px_row", "px_col", "ae")]).select("px_row", "px_col", "class_id", "z")


def tiled(spark, d):
    """Three rasters stored as tiles: labels, elevation and the first band of embeddings."""
    p, out = table(spark, d, "ae_pixels"), []
    for bands in (p.select("px_row", "px_col", "class_id"), table(spark, d, "dem"), p.select("px_row", "px_col", R.float_band("ae", 0).alias("ae_00"))):
        at, made = folder(spark, "raster"), L.dense(bands, 16)
        L.stored(made, at)
        out.append(L.opened(spark, at, 16, made.bands))
    return out


@query("SELECT a.px_row, a.px_col, a.class_id, d.z, CAST(a.ae[1] AS FLOAT) AS ae_00 FROM {ae_pixels} a JOIN {dem} d ON d.px_row = a.px_row AND d.px_col = a.px_col")
def j01_s02_stacked_tiles(spark, d):
    return L.pixels_of(L.stacked(*tiled(spark, d)))


@query("SELECT a.px_row + 5 AS px_row, a.px_col - 7 AS px_col, a.class_id, d.z FROM {ae_pixels} a JOIN {dem} d ON d.px_row = a.px_row + 5 AND d.px_col = a.px_col - 7")
def j01_shifted_stack(spark, d):
    labels, dem, _ = tiled(spark, d)
    return L.pixels_of(L.stacked(L.shifted(labels, 5, -7), dem))


@query("SELECT px_row, px_col, z FROM {dem} WHERE px_row BETWEEN 3 AND 18 AND px_col BETWEEN 10 AND 21")
def s08_tiled_window(spark, d):
    return L.pixels_of(L.windowed(tiled(spark, d)[1], 3, 18, 10, 21))


@query("SELECT px_row, px_col, z AS value FROM {dem}")
def s01_s08_tiles_round_trip(spark, d):
    return R.from_tiles(R.as_tiles(table(spark, d, "dem"), "z", 8))
