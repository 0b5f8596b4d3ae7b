"""Polygons and neighbourhoods against plain loops."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.operators import boundary as B
from landloom.operators import pixels as P
from landloom.operators import raster as R
from landloom.operators import sampling as S
from landloom.operators import sides as sides_module
from landloom.operators import vector as V


def star(rng, x, y, n, reach):
    turns, reaches = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.4, 1, n) * reach
    return [(float(x + r * math.cos(t)), float(y + r * math.sin(t))) for t, r in zip(turns, reaches, strict=True)]


@pytest.fixture(scope="module")
def shapes():
    rng, out = np.random.default_rng(1), []
    for k in range(12):
        x, y = rng.uniform(-20, 20, 2)
        outline = star(rng, x, y, 9, 9.0)
        out.append((k, k % 10 + 1, [outline, star(rng, x, y, 5, 2.0)] if k % 2 else [outline + outline[:1]]))
    return [*out, (12, 3, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]])]


@pytest.fixture(scope="module")
def features(spark, shapes):
    return spark.createDataFrame(shapes, "feature_id int, class_id int, rings array<array<struct<x double, y double>>>")


def sides(rings):
    return [(p, q) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True)]


def holds(rings, x, y):
    return sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in sides(rings)) % 2 == 1


def box(rings, step):
    xs, ys = zip(*rings[0], strict=True)
    return [(cx, cy) for cx in range(math.floor(min(xs) / step), math.ceil(max(xs) / step)) for cy in range(math.floor(min(ys) / step), math.ceil(max(ys) / step))]


@pytest.mark.parametrize("cell", [0.7, 3.0, 50.0])
def test_pixels_in_features(spark, shapes, features, cell):
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.random.default_rng(2).uniform(-32, 32, (2000, 2)))]
    p = spark.createDataFrame(points, "k int, x double, y double")
    want = sorted((k, f) for k, x, y in points for f, _, rings in shapes if holds(rings, x, y))
    assert sorted((r.k, r.feature_id) for r in V.pixels_in(p, features, cell).collect()) == want
    semi = V.pixels_in(p, features.select("rings"), cell, "left_semi")
    assert semi.columns == p.columns and sorted(r.k for r in semi.collect()) == sorted({k for k, _ in want})


def test_burned_and_touched_cells(shapes, features):
    step, burned, touched = 0.75, {}, []

    def meets(p, q, x0, y0):
        def part(a, d, lo):
            if d == 0:
                return (0.0, 1.0) if lo <= a <= lo + step else (2.0, -1.0)
            return min(t := [(lo - a) / d, (lo + step - a) / d]), max(t)

        a, b = part(p[0], q[0] - p[0], x0), part(p[1], q[1] - p[1], y0)
        return max(a[0], b[0], 0) <= min(a[1], b[1], 1)

    for f, kind, rings in shapes:
        for cx, cy in box(rings, step):
            centre = holds(rings, (cx + 0.5) * step, (cy + 0.5) * step)
            if centre:
                burned[cx, cy] = kind
            if centre or any(meets(p, q, cx * step, cy * step) for p, q in sides(rings)):
                touched.append((f, cx, cy))
    assert {(r.cx, r.cy): r.class_id for r in V.burned(features, step).collect()} == burned
    assert sorted(map(tuple, V.touched(features, step).collect())) == sorted(touched)


@pytest.fixture(scope="module")
def ground(spark):
    """Heights with gaps and blocks of two classes, at places below zero too."""
    rng = np.random.default_rng(3)
    z = {(r, c): None if rng.random() < 0.2 else float(rng.integers(0, 50)) for r in range(-7, 16) for c in range(-9, 22) if rng.random() < 0.95}
    kind = {(r, c): None if v is None else (r // 6 + c // 6) % 2 + 1 for (r, c), v in z.items()}
    return z, kind, spark.createDataFrame([(*k, z[k], kind[k], str(k)) for k in z], "px_row long, px_col int, z double, class_id int, tag string")


@pytest.mark.parametrize("size", [4, 5, 256])
def test_neighbourhoods_in_tiles(ground, size):
    z, kind, pixels = ground

    def filled(r, c):
        near = [((a * a + b * b, -a, -b), z[r + a, c + b]) for a in (-1, 0, 1) for b in (-1, 0, 1) if z.get((r + a, c + b)) is not None]
        return z[r, c] if z[r, c] is not None else min(near)[1] if near else None

    got = R.filled_seams(pixels, "z", size)
    assert got.columns == pixels.columns and {(r.px_row, r.px_col): r.z for r in got.collect()} == {k: filled(*k) for k in z}
    for reach in (1, 6):
        square = range(-reach, reach + 1)
        want = sorted((r, c) for (r, c), k in kind.items() if k is not None and all(kind.get((r + a, c + b)) == k for a in square for b in square))
        assert sorted((r.px_row, r.px_col) for r in R.interior(pixels, reach, size=size).collect()) == want
    shade = {(r.px_row, r.px_col): r.shade for r in R.hillshade(pixels, size=size).collect()}
    assert shade == {(r.px_row, r.px_col): r.shade for r in R.hillshade(pixels, size=7).collect()}
    assert sorted(shade) == sorted(k for k, v in z.items() if v is not None)


def test_tiles_of_empty_rasters_and_missing_places(spark, ground):
    pixels = ground[2]
    assert R.filled_seams(pixels.filter("false"), "z").count() == R.interior(pixels.filter("false"), 2).count() == 0
    lost = pixels.withColumn("px_row", F.lit(None).cast("long"))
    assert R.hillshade(lost).count() == 0
    target = spark.createDataFrame([(0, 0, 900.0, 900.0)], "px_row int, px_col int, u double, v double")
    assert R.warped(pixels, target, "lanczos", "z").collect() == [(0, 0, None)]


WEIGHTS = {
    "bilinear": (1, lambda x: max(0.0, 1 - x)),
    "cubic": (2, lambda x: 1.5 * x**3 - 2.5 * x * x + 1 if x < 1 else -0.5 * x**3 + 2.5 * x * x - 4 * x + 2 if x < 2 else 0.0),
    "cubicspline": (2, lambda x: 2 / 3 - x * x + x**3 / 2 if x < 1 else (2 - x) ** 3 / 6 if x < 2 else 0.0),
    "lanczos": (3, lambda x: 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 if x < 3 else 0.0),
}


@pytest.mark.parametrize("widen", [1.0, 2.5])
@pytest.mark.parametrize("method", sorted(WEIGHTS))
def test_warps_by_kernels(spark, ground, method, widen):
    z, _, pixels = ground
    cells = [(i, j, (j + 0.5) * 0.6 - 9, (i + 0.5) * 0.7 - 7) for i in range(40) for j in range(60)]
    target = spark.createDataFrame(cells, "px_row int, px_col int, u double, v double")
    got = {(r.px_row, r.px_col): r.z for r in R.warped(pixels, target, method, "z", widen, 6).collect()}
    assert len(got) == len(cells)
    half, weight = WEIGHTS[method]
    reach = math.ceil(half * widen) + 1
    for i, j, u, v in cells[::17]:
        near = [(weight(abs(v - 0.5 - r) / widen) * weight(abs(u - 0.5 - c) / widen), z[r, c]) for r in range(math.floor(v) - reach, math.floor(v) + reach + 1) for c in range(math.floor(u) - reach, math.floor(u) + reach + 1) if z.get((r, c)) is not None]
        whole = sum(w for w, _ in near)
        if abs(whole) < 1e-6:
            assert got[i, j] is None
        elif abs(whole) > 1e-3:
            assert got[i, j] == pytest.approx(sum(w * x for w, x in near) / whole, rel=1e-8, abs=1e-8)


@pytest.mark.parametrize("cap", [5, 300, 4000])
def test_capped_groups(spark, monkeypatch, cap):
    monkeypatch.setattr(S, "SECOND_RANK_ROWS", 1000)
    rows = spark.range(20000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"))
    groups = defaultdict(list)
    for r in rows.select("g", F.xxhash64("id").alias("h"), "id").collect():
        groups[r.g].append((r.h, r.id))
    got = S.capped(rows, ["g"], [F.xxhash64("id"), F.col("id")], cap, 16)
    assert got.columns == rows.columns and sorted(r.id for r in got.collect()) == sorted(i for v in groups.values() for _, i in sorted(v)[:cap])


def test_clip_and_warp_to_metres(spark):
    from landloom.queries.rasters import metric_cells

    plane = spark.range(900).select(F.expr("id div 30").alias("px_row"), (F.col("id") % 30).alias("px_col"))
    plane = plane.withColumns({"x": F.col("px_col") + 0.5, "y": F.col("px_row") + 0.5}).withColumn("z", F.col("x") + 2 * F.col("y"))
    region = spark.createDataFrame([([[(5.0, 5.0), (20.0, 5.0), (20.0, 20.0), (5.0, 20.0)]],)], "rings array<array<struct<x double, y double>>>")
    cells = metric_cells(plane)
    got = R.clipped_and_warped(plane, region, 4.0, cells, "bilinear", "z").join(cells, ["px_row", "px_col"]).collect()
    inner = [r for r in got if 5.5 <= r.u <= 19.5 and 5.5 <= r.v <= 19.5]
    assert len(inner) > 100 and all(r.z == pytest.approx(r.u + 2 * r.v, abs=1e-6) for r in inner)
    assert len(got) == cells.count() and all(r.z is None for r in got if not (4.5 < r.u < 20.5 and 4.5 < r.v < 20.5))


@pytest.mark.parametrize("accuracy", [4, 50, 100_000])
def test_percentiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=1003), rng.integers(0, 9, 400), [7.0], [1.0, 2.0], np.repeat([0.0, 5.0], [990, 10])):
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "b double").repartition(5)
        for low, high in ((0.02, 0.98), (0.0, 1.0), (0.49, 0.51)):
            got = P.percentiles(rows, "b", low, high, accuracy).first()
            assert got["_q"] == pytest.approx(list(np.quantile(np.asarray(x, float), [low, high])), abs=1e-9)
            assert (got["_lo"], got["_hi"]) == (min(x), max(x))


def comb(n, height, width=1.0):
    """A rectilinear outline with ``n`` teeth, whose corners lie on a lattice."""
    top = [(x, y) for k in range(n) for x, y in ((2 * k * width, 0.0), (2 * k * width, height * (1 + k % 3)), ((2 * k + 1) * width, height * (1 + k % 3)), ((2 * k + 1) * width, 0.0))]
    return [*top, ((2 * n - 1) * width, -1.0), (0.0, -1.0)]


@pytest.mark.parametrize("cell", [1.0, 512.0])
def test_many_sides_and_corners_on_the_lattice(spark, cell):
    wavy = [(8.0 + (2 + 0.3 * math.sin(40 * t)) * math.cos(t), 3.0 + (2 + 0.3 * math.sin(40 * t)) * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 700, endpoint=False)]
    shapes = [(1, [comb(90, 2.0)]), (2, [comb(40, 1.0, 0.25), [(1.0, -0.75), (5.0, -0.75), (5.0, -0.25), (1.0, -0.25)]]), (3, [wavy]), (3, [wavy[::-1]]), (4, [[(0.0, 0.0), (0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]]), (4, [[(0.0, 0.0), (0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]]), (5, []), (6, [[]])]
    features = spark.createDataFrame(shapes, "feature_id int, rings array<array<struct<x double, y double>>>")
    xs = [(float(x), float(y)) for x in np.arange(-1, 24, 0.5) for y in np.arange(-2, 8, 0.25)] + [tuple(map(float, p)) for p in np.random.default_rng(4).uniform(-1, 12, (1500, 2))]
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(xs)], "k int, x double, y double")
    want = sorted((k, f) for k, (x, y) in enumerate(xs) for f, rings in shapes if holds(rings, x, y))
    assert sorted((r.k, r.feature_id) for r in V.pixels_in(points, features, cell).collect()) == want
    assert sorted(r.k for r in V.pixels_in(points, features.select("rings"), cell, "left_semi").collect()) == sorted({k for k, _ in want})
    levels = sides_module.cells_of(sides_module.side_rows(sides_module.keyed(features).select("_key", "rings")), cell)
    assert max(c.agg(F.max(F.size("sides"))).first()[0] for c, _ in levels) <= sides_module.CELL_SIDES and (len(levels) > 1) == (cell > 1)


def test_sides_of_one_feature_are_on_many_tasks(spark):
    one = spark.createDataFrame([(1, [comb(2000, 1.0)])], "feature_id int, rings array<array<struct<x double, y double>>>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = sides_module.side_rows(sides_module.keyed(one).select("_key", "rings")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 8002 * 0.6


def components(cells, box):
    """4-connected components of ``cells`` within ``box``."""
    left, out = set(cells), []
    while left:
        todo, got = [left.pop()], set()
        while todo:
            at = todo.pop()
            got.add(at)
            near = {(at[0] + dx, at[1] + dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))} & left
            left -= near
            todo += near
        out.append(got)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_boundary_rings_of_squares(spark, seed):
    rng, n = np.random.default_rng(seed), 9
    squares = {(int(x), int(y)) for x in range(n) for y in range(n) if rng.random() < 0.6}
    squares |= {(20, 20), (21, 21), (30, 0), (31, 0), (32, 0), (30, 1), (32, 1), (30, 2), (31, 2)}  # two that touch at a corner, and a ring closed at a corner only

    def around(x, y):
        ring = [(float(x), float(y)), (x + 1.0, float(y)), (x + 1.0, y + 1.0), (float(x), y + 1.0)]
        return [ring if rng.random() < 0.5 else ring[::-1] + ring[-1:]]

    rows = [(k, around(x, y)) for k, (x, y) in enumerate(sorted(squares))]
    features = spark.createDataFrame([*rows, rows[0]], "feature_id int, rings array<array<struct<x double, y double>>>").repartition(3)
    want, box = Counter(), {(x, y) for x in range(-1, 36) for y in range(-1, 36)}
    for part in components(squares, box):
        gaps = [g for g in components(box - part, box) if (-1, -1) not in g]
        want[False, float(len(part) + sum(map(len, gaps)))] += 1
        want.update((True, float(len(g))) for g in gaps)
    got = B.boundary_rings(features, holes=True).collect()
    rings = defaultdict(list)
    for r in got:
        rings[r.ring, r.part, r.hole, r.area].append((r.position, (r.x, r.y)))
    assert Counter((hole, area) for _, _, hole, area in rings) == want and any(hole for _, _, hole, _ in rings)
    shapes = {}
    for (ring, part, hole, area), corners in rings.items():
        places, corners = zip(*sorted(corners), strict=True)
        assert places == tuple(range(len(corners))) and len(set(corners)) == len(corners)
        assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in sides([list(corners)]))
        assert sum(p[0] * q[1] - q[0] * p[1] for p, q in sides([list(corners)])) / 2 == (-area if hole else area)
        shapes[ring] = (part, hole, area, list(corners))
    for ring, (part, hole, _, corners) in shapes.items():
        if hole:
            (px, py), (qx, qy) = corners[:2]
            holders = [r for r, (_, h, _, c) in shapes.items() if not h and holds([c], (px + qx) / 2 + 1e-6 * (py - qy), (py + qy) / 2 + 1e-6 * (qx - px))]
            assert part == min(holders, key=lambda r: shapes[r][2])
        else:
            assert part == ring
    outer = B.boundary_rings(features).collect()
    assert Counter(map(tuple, outer)) == Counter(tuple(r) for r in got if not r.hole)


def test_boundary_of_a_feature_with_a_hole_and_of_nothing(spark):
    kind = "feature_id int, rings array<array<struct<x double, y double>>>"
    one = spark.createDataFrame([(1, [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]), (2, None), (3, [])], kind)
    assert sorted({(r.hole, r.area) for r in B.boundary_rings(one, holes=True).collect()}) == [(False, 16.0), (True, 1.0)]
    assert B.boundary_rings(one.filter("feature_id > 1"), holes=True).count() == 0


@pytest.mark.parametrize("cap", [700, 17_000])
def test_cut_of_a_class_of_nearly_all_rows(spark, monkeypatch, cap):
    """Ties, nulls and a class of nine tenths of all rows; no rank sees more than a bounded number of its rows."""
    monkeypatch.setattr(S, "SECOND_RANK_ROWS", 500)
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(-1).alias("g"), F.when(F.col("id") % 11 > 0, (F.col("id") * 37) % 1009).alias("o"), F.lit("x").alias("_n"))
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r.g].append((r.o is not None, r.o or 0, r.id))
    got = S.capped(rows.repartition(4), ["g"], [F.col("o"), F.col("id")], cap, 8)
    assert got.columns == rows.columns and sorted(r.id for r in got.collect()) == sorted(k for v in groups.values() for _, _, k in sorted(v)[:cap])
    tied = S.capped(rows, ["g"], [F.col("o")], cap, 8).collect()  # about 18 rows share each value
    for g, v in groups.items():
        assert sorted((r.o is not None, r.o or 0) for r in tied if r.g == g) == [x[:2] for x in sorted(v)[:cap]]
    even = S.capped(rows.withColumn("o", F.lit(5)), ["g"], [F.col("o")], cap, 8).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in even} == {g: min(cap, len(v)) for g, v in groups.items()}
    narrow = rows.select(F.struct("g").alias("_g"), F.struct(F.col("o").alias("_o0"), F.col("id").alias("_o1")).alias("_at"))
    cuts = {r._g.g: (r._cut._o1, r._take) for r in S._cut_rows(narrow, cap, 8).collect()}
    assert cuts == {g: (sorted(v)[cap - 1][2], 1) for g, v in groups.items() if len(v) > cap}
    assert S.capped(rows.filter("false"), ["g"], [F.col("o")], cap).count() == 0
    assert all(r._n <= 500 for r in S._narrowed(narrow, cap, 8).collect())  # what the last rank sees of a class
