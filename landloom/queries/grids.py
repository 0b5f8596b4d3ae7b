"""Queries of grids, blocks and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.operators import grid as G
from landloom.queries import query
from landloom.sources.derived import table

GRID = "SELECT *, 200000.0::DOUBLE AS c, 2500000.0::DOUBLE AS f, 10.0::DOUBLE AS a, -10.0::DOUBLE AS e FROM {ae_pixels}"
AREAS = "SELECT c_custkey, 88.0 + c_nationkey * 0.25 AS minx, 21.0 + c_nationkey * 0.125 AS miny, 88.5 + c_nationkey * 0.25 + c_custkey % 4 * 0.25 AS maxx, 21.5 + c_nationkey * 0.125 + c_custkey % 3 * 0.25 AS maxy FROM {customer}"


def gridded(spark, d):
    return table(spark, d, "ae_pixels").withColumns({"c": F.lit(200000.0), "f": F.lit(2500000.0), "a": F.lit(10.0), "e": F.lit(-10.0)})


def areas(spark, d):
    c = table(spark, d, "customer")
    x, y = 88.0 + F.col("c_nationkey") * 0.25, 21.0 + F.col("c_nationkey") * 0.125
    return c.select("c_custkey", x.alias("minx"), y.alias("miny"), (x + 0.5 + F.col("c_custkey") % 4 * 0.25).alias("maxx"), (y + 0.5 + F.col("c_custkey") % 3 * 0.25).alias("maxy"))


@query(f"SELECT sample_id, c + a * (px_col + 0.5) AS x, f + e * (px_row + 0.5) AS y FROM ({GRID})")
def g01_pixel_to_world(spark, d):
    return G.to_world(gridded(spark, d)).select("sample_id", "x", "y")


@query("SELECT l_orderkey, l_partkey, CAST(floor((l_extendedprice - 100.0) / 10.0) AS BIGINT) AS px_col, CAST(floor((l_quantity - 500.0) / -10.0) AS BIGINT) AS px_row FROM {lineitem}")
def g02_world_to_pixel(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.lit(100.0).alias("c"), F.lit(10.0).alias("a"), F.lit(500.0).alias("f"), F.lit(-10.0).alias("e"))
    return G.to_pixel(p).select("l_orderkey", "l_partkey", "px_col", "px_row")


@query("""SELECT p.grid_id AS grid_a, q.grid_id AS grid_b, CAST(floor((greatest(p.c, q.c) - p.c) / p.a + 0.5) AS BIGINT) AS col_off, 0::BIGINT AS row_off,
 CAST(least(floor((least(p.c + p.width * p.a, q.c + q.width * q.a) - greatest(p.c, q.c)) / p.a + 0.5), p.width - floor((greatest(p.c, q.c) - p.c) / p.a + 0.5)) AS BIGINT) AS n_cols, 80::BIGINT AS n_rows
 FROM {grids} p JOIN {grids} q ON p.epsg = q.epsg WHERE q.grid_id = 'g0' AND least(p.c + p.width * p.a, q.c + q.width * q.a) > greatest(p.c, q.c)""")
def g03_overlap_window(spark, d):
    g = table(spark, d, "grids")
    return G.overlap(g, g.filter("grid_id = 'g0'"))


@query("SELECT o_orderkey, floor(o_custkey / 30.0) * 30.0 AS minx, floor(o_orderkey / 30.0) * 30.0 AS miny, ceil((o_custkey + 7) / 30.0) * 30.0 AS maxx, ceil((o_orderkey + 11) / 30.0) * 30.0 AS maxy FROM {orders}")
def g04_snapped_bounds(spark, d):
    b = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("minx"), F.col("o_orderkey").alias("miny"), (F.col("o_custkey") + 7).alias("maxx"), (F.col("o_orderkey") + 11).alias("maxy"))
    return G.snapped(b, 30.0)


@query("""SELECT p.grid_id, p.width = q.width AND abs(p.c - q.c) <= 1e-6 AS close, p.width = q.width AND abs(p.c - q.c) <= 1e-9 AS exact
 FROM {grids} p, {grids} q WHERE q.grid_id = 'g0'""")
def g05_same_grid(spark, d):
    g = table(spark, d, "grids")
    both = g.alias("p").join(F.broadcast(g.filter("grid_id = 'g0'").alias("q")), how="cross")
    return both.select("p.grid_id", G.same_grid(1e-6).alias("close"), G.same_grid(1e-9).alias("exact"))


@query("SELECT sample_id, px_row // 5 AS block_row, px_col // 5 AS block_col, printf('%d:r%04d_c%04d', area, px_row // 5, px_col // 5) AS block_id FROM {ae_pixels}")
def g06_block_names(spark, d):
    return G.with_blocks(table(spark, d, "ae_pixels"), 5).select("sample_id", "block_row", "block_col", "block_id")


@query("SELECT sample_id, xor(xor(px_row // 5 * 73856093, px_col // 5 * 19349663), 42::BIGINT * 83492791) % 10000000 / 10000000.0::DOUBLE AS u FROM {ae_pixels}")
def g07_block_hash(spark, d):
    return G.with_blocks(table(spark, d, "ae_pixels"), 5).select("sample_id", G.block_fraction(42).alias("u"))


@query("SELECT grid_id, abs(a * e)::DOUBLE AS area_m2, (abs(a * e) / 1e4)::DOUBLE AS area_ha, (abs(a * e) / 1e6)::DOUBLE AS area_km2 FROM {grids}")
def g08_pixel_area(spark, d):
    return table(spark, d, "grids").select("grid_id", *(v.cast("double").alias(k) for k, v in G.pixel_area().items()))


@query(f"""SELECT c_custkey, CAST(r.r AS INT) AS tile_row, CAST(k.k AS INT) AS tile_col, round(minx + k.k * sx, 9) AS tile_x0, round(miny + r.r * sy, 9) AS tile_y0 FROM (
 SELECT *, 45.0::DOUBLE / (111.32::DOUBLE * cos(radians((miny + maxy) / 2))) AS sx, 45.0::DOUBLE / 111.32::DOUBLE AS sy FROM ({AREAS})) a, range(0, 20) r(r), range(0, 20) k(k)
 WHERE r.r < ceil((maxy - miny) / sy) AND k.k < ceil((maxx - minx) / sx) AND minx + k.k * sx < maxx AND miny + r.r * sy < maxy""")
def g09_overlapping_tiles(spark, d):
    t = G.overlapping_tiles(areas(spark, d), 50.0, 50.0, 5.0)
    return t.select("c_custkey", "tile_row", "tile_col", F.round("tile_x0", 9).alias("tile_x0"), F.round("tile_y0", 9).alias("tile_y0"))


@query(f"""SELECT c_custkey, tile_row, tile_col, round(x1, 9) AS tile_x1, round(y1, 9) AS tile_y1 FROM (SELECT *, least(x0 + 50.0::DOUBLE / (111.32::DOUBLE * cos(radians(my))), maxx) AS x1, least(y0 + 50.0::DOUBLE / 111.32::DOUBLE, maxy) AS y1
 FROM (SELECT *, CAST(r.r AS INT) AS tile_row, CAST(k.k AS INT) AS tile_col, minx + k.k * sx AS x0, miny + r.r * sy AS y0 FROM (SELECT *, (minx + maxx) / 2 AS mx, (miny + maxy) / 2 AS my,
 45.0::DOUBLE / (111.32::DOUBLE * cos(radians((miny + maxy) / 2))) AS sx, 45.0::DOUBLE / 111.32::DOUBLE AS sy FROM ({AREAS})) a, range(0, 20) r(r), range(0, 20) k(k)
 WHERE minx + k.k * sx < maxx AND miny + r.r * sy < maxy)) WHERE abs(greatest(least(mx, x1), x0) - mx) / (maxx - mx) + abs(greatest(least(my, y1), y0) - my) / (maxy - my) < 1""")
def g09_tiles_of_shapes(spark, d):
    """Tiles that overlap a rhombus between the middles of each area's bounds."""
    mx, my = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    ends = ((mx, F.col("miny")), (F.col("maxx"), my), (mx, F.col("maxy")), (F.col("minx"), my))
    rhombus = F.array(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ends)))
    t = G.overlapping_tiles(areas(spark, d).withColumn("rings", rhombus), 50.0, 50.0, 5.0)
    return t.select("c_custkey", "tile_row", "tile_col", F.round("tile_x1", 9).alias("tile_x1"), F.round("tile_y1", 9).alias("tile_y1"))


@query(f"""SELECT c_custkey, CAST(r.r AS INT) AS tile_row, CAST(k.k AS INT) AS tile_col, least(minx + (k.k + 1) * 0.375::DOUBLE, maxx)::DOUBLE AS tile_x1, least(miny + (r.r + 1) * 0.375::DOUBLE, maxy)::DOUBLE AS tile_y1
 FROM ({AREAS}) a, range(0, 20) r(r), range(0, 20) k(k) WHERE r.r < ceil((maxy - miny) / 0.375::DOUBLE) AND k.k < ceil((maxx - minx) / 0.375::DOUBLE)""")
def g10_degree_tiles(spark, d):
    return G.degree_tiles(areas(spark, d), 0.375).select("c_custkey", "tile_row", "tile_col", "tile_x1", "tile_y1")


@query(f"SELECT c_custkey, round(10.0 / 111.32::DOUBLE, 9) AS deg_lat, round(10.0 / (111.32::DOUBLE * cos(radians(miny))), 9) AS deg_lon FROM ({AREAS})")
def g11_km_to_degrees(spark, d):
    return areas(spark, d).select("c_custkey", *(F.round(v, 9).alias(k) for k, v in G.degrees(10.0, F.col("miny")).items()))


@query(f"SELECT * FROM ({AREAS})")
def g12_corner_bounds(spark, d):
    a = areas(spark, d)
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("minx", "maxy"), ("maxx", "maxy"), ("maxx", "miny"), ("minx", "miny"))))
    return a.select("c_custkey", corners.alias("corners")).select("c_custkey", *(v.alias(k) for k, v in G.corner_bounds("corners").items()))


@query("SELECT c_custkey, CAST(88 + c_custkey % 6 AS INT) AS tile_x0, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (20 + c_nationkey % 5) AS INT) AS tile_y0 FROM {customer} WHERE c_custkey % 2 = 0 AND 88 + c_custkey % 6 < 92.5 AND 89 + c_custkey % 6 > 89 AND 20 + c_nationkey % 5 < 23 AND 21 + c_nationkey % 5 > 21")
def g13_named_tiles(spark, d):
    named = table(spark, d, "customer").withColumn("file", F.format_string("%s%02dE%03d_2020.tif", F.when(F.col("c_custkey") % 2 == 0, "N").otherwise("S"), 20 + F.col("c_nationkey") % 5, 88 + F.col("c_custkey") % 6))
    return named.withColumns(G.named_tile_bounds("file")).filter(G.meets(89.0, 21.0, 92.5, 23.0)).select("c_custkey", "tile_x0", "tile_y0")


@query("SELECT min(c) AS \"left\", max(f)::DOUBLE AS top, max(c + width * 10.0) AS \"right\", min(f - height * 10.0)::DOUBLE AS bottom, CAST(ceil((max(c + width * 10.0) - min(c)) / 10.0 - 1e-9) AS BIGINT) AS width, CAST(ceil((max(f) - min(f - height * 10.0)) / 10.0 - 1e-9) AS BIGINT) AS height FROM {grids}")
def g31_mosaic_extent(spark, d):
    out = G.mosaic_extent(table(spark, d, "grids"))
    return out.select("left", F.col("top").cast("double").alias("top"), "right", F.col("bottom").cast("double").alias("bottom"), "width", "height")


@query("SELECT DISTINCT px_row // 5 AS block_row, px_col // 5 AS block_col, px_row // 5 * 5 - 6 AS top, px_col // 5 * 5 - 7 AS \"left\", 5 AS side FROM {ae_pixels} WHERE px_row // 5 BETWEEN 0 AND 3 AND px_col // 5 BETWEEN 0 AND 3")
def g35_blocks_in_window(spark, d):
    b = G.with_blocks(table(spark, d, "ae_pixels"), 5).select("block_row", "block_col").distinct()
    return G.blocks_in_window(b, 5, 6, 7, 5, 6, 1)


_V01 = "SELECT p.grid_id, p.epsg = q.epsg AS same_epsg, p.width = q.width AS same_width, p.height = q.height AS same_height, abs(p.c - q.c) <= {t} AS same_transform, p.width = q.width AND abs(p.c - q.c) <= {t} AS ready FROM {{grids}} p, {{grids}} q WHERE q.grid_id = 'g0'"


@query(_V01.format(t="1e-9"))
def v01_readiness_report(spark, d):
    return G.grid_report(table(spark, d, "grids"), "g0")


@query(_V01.format(t="1e-6") + " AND p.width = q.width AND abs(p.c - q.c) <= 1e-6")
def v02_input_checks(spark, d):
    return G.require_ready(G.grid_report(table(spark, d, "grids"), "g0", 1e-6).filter("same_width and same_transform"))


@query(_V01.format(t="1e-6"))
def v03_index_grid_checks(spark, d):
    return G.grid_report(table(spark, d, "grids"), "g0", 1e-6)
