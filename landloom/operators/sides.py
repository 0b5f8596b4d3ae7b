"""Polygons by their sides: one row per side, so that no task ever holds a whole polygon.

A point is in a polygon if a ray from it towards greater x crosses an odd number
of sides.  Space is cut into square cells.  Of the sides that a row of cells
meets, those that end left of a cell don't count, those in the cell are tested
one by one, and those that begin right of it count as a parity: taken at the foot
of the row by a running sum along it, and changed by each corner on the way up to
the point.  Corners between two sides beyond the cell change it twice, so the
cell's own sides know all that count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.sources.shared import written

#: Sides that a cell keeps; a cell with more is cut into ``SPLIT`` x ``SPLIT`` cells.
CELL_SIDES, SPLIT = 64, 16

#: Deepest cut: the smallest cells are ``SPLIT`` ** ``LEVELS`` times smaller and keep whatever sides they have.
LEVELS = 5

_ENDS = ["px", "py", "qx", "qy"]


def keyed(features: DataFrame) -> DataFrame:
    """``features`` with ``_key``, which equal rows share."""
    return features.withColumn("_key", F.xxhash64(*features.columns))


def with_features(cells: DataFrame, features: DataFrame) -> DataFrame:
    """``cells`` with the columns of the keyed ``features``; both are shuffled, as features may be too many to meet in the driver for a broadcast."""
    return cells.join(features.hint("merge"), "_key")


def side_rows(shapes: DataFrame) -> DataFrame:
    """Sides of the rings of ``shapes`` (_key, rings): _key, px, py, qx, qy.

    Equal features give their sides once.  That step deals the sides of each
    feature to all tasks.  Before it, features are dealt, as a table of a
    single file is one task, and equal sides are sought only after both, so
    that no task gathers the sides of all.  Sides without length are left out.
    """
    ring = shapes.repartition("_key").select("_key", F.posexplode("rings").alias("_ring", "r"))
    nxt = F.concat(F.slice("r", F.lit(2), F.size("r")), F.slice("r", 1, 1))
    s = ring.select("_key", "_ring", F.posexplode(F.arrays_zip(F.col("r").alias("p"), nxt.alias("q"))).alias("_at", "s"))
    flat = s.select("_key", "_ring", "_at", *(F.col(f"s.{e[0]}.{e[1]}").alias(e) for e in _ENDS)).repartition("_key", "_ring", "_at").dropDuplicates(["_key", "_ring", "_at"])
    return flat.filter("px <> qx OR py <> qy").select("_key", *_ENDS)


def meeting(y: Column) -> Column:
    """Where a side meets a height that it crosses."""
    return F.col("px") + F.try_divide((y - F.col("py")) * (F.col("qx") - F.col("px")), F.col("qy") - F.col("py"))


def _pad(v: Column, step: float) -> Column:
    """More than any rounding error of a place."""
    return F.abs(v) * 1e-12 + step * 1e-6


def _column(x: Column, step: float) -> Column:
    """Column of a place, or the one before it where rounding may matter."""
    return F.floor((x - _pad(x, step)) / step)


def _foot(cy: Column, step: float) -> Column:
    """Height just below a row of cells, at which parities are taken."""
    return cy * step - (F.abs(cy) * step * 1e-13 + step * 1e-7)


def _rows(s: DataFrame, step: float) -> DataFrame:
    """Sides once for each row ``cy`` of cells that they reach."""
    low, high = F.least("py", "qy"), F.greatest("py", "qy")
    return s.withColumn("cy", F.explode(F.sequence(F.floor((low - _pad(low, step)) / step), F.floor((high + _pad(high, step)) / step))))


def _spanned(s: DataFrame, step: float) -> DataFrame:
    """Adds the columns from ``c`` to ``r`` that the part of a side in its row spans, and whether it crosses the row's foot."""
    left, right, low, high = (f(F.col(a), F.col(b)) for a, b in (("px", "qx"), ("py", "qy")) for f in (F.least, F.greatest))
    foot, head = F.col("cy") * step, (F.col("cy") + 1) * step
    a, b = foot - 2 * _pad(foot, step), head + 2 * _pad(head, step)

    def end(x: str, y: str) -> Column:
        cut = F.when(F.col(y) < a, meeting(a)).when(F.col(y) > b, meeting(b)).otherwise(F.col(x))
        return F.least(F.greatest(cut, left), right)

    x0, x1, foot = end("px", "py"), end("qx", "qy"), _foot(F.col("cy"), step)
    last = F.greatest(x0, x1)
    return s.withColumns({"c": _column(F.least(x0, x1), step), "r": F.floor((last + _pad(last, step)) / step), "starts": ((low <= foot) & (foot < high)).cast("long")})


def _along(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the parity of what begins right of them (``n`` sides of their own, ``starts`` that begin in them and cross the foot)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("cx"))
    beyond = F.coalesce(F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumns({"parity": beyond % 2, "_next": F.lag("cx").over(w)})


def _sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "cx").agg(F.sum("n").alias("n"), F.sum("starts").alias("starts"))


def _gathered(own: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """Cells with their few sides as an array; ends that change the parity on the way up are marked."""

    def turns(e: str) -> Column:
        return (_column(F.col(f"{e}x"), step) > F.col("cx")) & (F.col(f"{e}y") > _foot(F.col("cy"), step))

    s = F.struct(*_ENDS, turns("p").alias("pt"), turns("q").alias("qt"))
    at = ["_key", "cy", "cx"]
    return own.join(cells.select(*at, "parity"), at).groupBy(*at, "parity").agg(F.collect_list(s).alias("sides"))


def _inner(cells: DataFrame) -> DataFrame:
    """Cells without sides, in the gaps of rows, that are inside."""
    gaps = cells.filter("parity = 1 AND _next > cx + 1")
    return gaps.select("_key", "cy", F.explode(F.sequence(F.col("cx") + 1, F.col("_next") - 1)).alias("cx"), F.lit(1).cast("long").alias("parity"))


def _divided(own: DataFrame, heavy: DataFrame, step: float) -> tuple[DataFrame, DataFrame]:
    """Sides and cells of the next level below ``heavy`` cells of size ``step``.

    What begins right of a heavy cell counts as beginning in a column behind
    its last one: its parity at the foot of the cell, changed by the corners
    below each finer row.
    """
    fine, at = step / SPLIT, ["_key", "cy", "cx"]
    s = own.join(heavy.select(*at, "parity"), at).withColumnsRenamed({"cy": "hy", "cx": "hx"})
    first, behind, low = F.col("hx") * SPLIT, (F.col("hx") + 1) * SPLIT, F.col("hy") * SPLIT
    keys = ["_key", "hy", "hx", "cy"]
    cut = _spanned(_rows(s, fine).filter(F.col("cy").between(low, low + SPLIT - 1)), fine).filter(F.col("r") >= first)
    cut = cut.withColumns({"c": F.least(F.greatest("c", first), behind), "r": F.least("r", behind - 1)})
    each = F.explode(F.when(F.col("c") < behind, F.sequence("c", F.greatest("c", "r"))).otherwise(F.array(behind)))
    parts = cut.withColumn("cx", each)
    counted = parts.select(*keys, "cx", (F.col("cx") < behind).cast("long").alias("n"), F.when(F.col("cx") == F.col("c"), F.col("starts")).otherwise(0).alias("starts"))
    rows = heavy.select("_key", F.col("cy").alias("hy"), F.col("cx").alias("hx"), "parity").withColumn("cy", F.explode(F.sequence(low, low + SPLIT - 1)))
    grid = rows.withColumn("cx", F.explode(F.sequence(first, behind))).select(*keys, "cx", F.lit(0).cast("long").alias("n"), F.when(F.col("cx") == behind, F.col("parity")).otherwise(0).alias("starts"))
    ends = reduce(DataFrame.unionByName, [s.select("_key", "hy", "hx", F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "pq"])
    ends = ends.filter((_column(F.col("x"), step) > F.col("hx")) & (F.col("y") > _foot(F.col("hy"), step)))
    turned = ends.withColumn("cy", F.explode(F.sequence(low, low + SPLIT - 1))).filter(F.col("y") <= _foot(F.col("cy"), fine))
    turned = turned.select(*keys, behind.alias("cx"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("starts"))
    cells = _along(_sums(counted.unionByName(grid).unionByName(turned), keys), keys).filter((F.col("cx") < behind) & ((F.col("n") > 0) | (F.col("parity") == 1)))
    return parts.filter(F.col("cx") < behind).select(*at, *_ENDS), cells.select(*at, "n", "parity")


def cells_of(sides: DataFrame, cell: float) -> list[tuple[DataFrame, float]]:
    """Cells of every level of closed chains of ``sides`` (_key and ends), with their size: _key, cy, cx, parity, sides; those outside are left out.

    Each level's sides and cells are written once; deeper levels are made only
    where cells have more than ``CELL_SIDES`` sides.
    """
    at = ["_key", "cy", "cx"]
    parts = _spanned(_rows(sides, cell), cell).withColumn("cx", F.explode(F.sequence("c", F.greatest("c", "r"))))
    own = written(parts.select(*at, *_ENDS, F.when(F.col("cx") == F.col("c"), F.col("starts")).otherwise(0).alias("starts")), "sides")
    cells = written(_along(_sums(own.withColumn("n", F.lit(1).cast("long")), ["_key", "cy"]), ["_key", "cy"]), "cells")
    step, out, inside = cell, [], _inner(cells)
    empty = F.array().cast("array<struct<px:double,py:double,qx:double,qy:double,pt:boolean,qt:boolean>>")
    for level in range(LEVELS + 1):
        heavy = cells.filter(F.col("n") > CELL_SIDES)
        last = level == LEVELS or heavy.isEmpty()
        few = cells.filter("n > 0") if last else cells.filter(F.col("n").between(1, CELL_SIDES))
        out.append((_gathered(own, few, step).select(*at, "parity", "sides").unionByName(inside.withColumn("sides", empty)), step))
        if last:
            return out
        own, cells = (written(t, "cells") for t in _divided(own, heavy, step))
        inside = cells.filter("n = 0 AND parity = 1").select(*at, "parity")
        step /= SPLIT
    return out


def holds(x: Column, y: Column) -> Column:
    """Whether a point of a cell (_parity, _sides) is inside."""

    def crossings(s: Column) -> Column:
        over = ((s["py"] > y) != (s["qy"] > y)) & (x < s["px"] + F.try_divide((y - s["py"]) * (s["qx"] - s["px"]), s["qy"] - s["py"]))
        return over.cast("long") + (s["pt"] & (s["py"] <= y)).cast("long") + (s["qt"] & (s["qy"] <= y)).cast("long")

    return F.aggregate("_sides", F.col("_parity"), lambda n, s: n + F.coalesce(crossings(s), F.lit(0))) % 2 == 1


def points_in(points: DataFrame, features: DataFrame, cell: float, how: str) -> DataFrame:
    """Pairs of a point (x, y) and a feature that holds it, or with ``how`` "left_semi" each point that one holds."""
    shapes = keyed(features)
    left, out = points, []
    for cells, step in cells_of(side_rows(shapes.select("_key", "rings")), cell):
        cells = cells.withColumnsRenamed({"cy": "_fy", "cx": "_fx"})
        if how != "left_semi" and len(features.columns) > 1:
            cells = with_features(cells, shapes.drop("rings"))
        cells = cells.drop("_key").withColumnsRenamed({"parity": "_parity", "sides": "_sides"})
        out.append(_met(left, cells, step, how))
        if how == "left_semi":
            left = _met(left, cells, step, "left_anti")
    return reduce(DataFrame.unionByName, out)


def holders(points: DataFrame, sides: DataFrame, cell: float) -> DataFrame:
    """Pairs of a point (x, y) and the ``_key`` of closed ``sides`` that hold it."""
    out = []
    for cells, step in cells_of(sides, cell):
        out.append(_met(points, cells.withColumnsRenamed({"cy": "_fy", "cx": "_fx", "parity": "_parity", "sides": "_sides"}), step, "inner"))
    return reduce(DataFrame.unionByName, out)


def _met(points: DataFrame, cells: DataFrame, step: float, how: str) -> DataFrame:
    at = points.withColumns({"_cx": F.floor(F.col("x") / step), "_cy": F.floor(F.col("y") / step)})
    inside = holds(F.col("x"), F.col("y"))
    return at.join(cells, (F.col("_cx") == F.col("_fx")) & (F.col("_cy") == F.col("_fy")) & inside, how).drop("_cx", "_cy", "_fx", "_fy", "_parity", "_sides")


def filled(s: DataFrame, step: float) -> DataFrame:
    """Cells (_key, cx, cy) whose centres lie between every other crossing of their row's middle."""
    low, high, y = F.least("py", "qy"), F.greatest("py", "qy"), (F.col("cy") + 0.5) * step
    rows = s.withColumn("cy", F.explode(F.sequence(F.floor(low / step - 0.5), F.ceil(high / step - 0.5))))
    met = rows.filter((F.col("py") > y) != (F.col("qy") > y)).select("_key", "cy", meeting(y).alias("a"))
    w = Window.partitionBy("_key", "cy").orderBy("a")
    spans = met.withColumns({"_nth": F.row_number().over(w), "b": F.lead("a").over(w)}).filter("_nth % 2 = 1")
    cells = spans.withColumn("cx", F.explode(F.sequence(F.ceil(F.col("a") / step - 0.5) - 1, F.ceil(F.col("b") / step - 0.5))))
    centre = (F.col("cx") + 0.5) * step
    return cells.filter((centre >= F.col("a")) & (centre < F.col("b"))).select("_key", "cx", "cy")


def along(s: DataFrame, step: float) -> DataFrame:
    """Cells (_key, cx, cy) that a side runs through or touches, once for each side."""

    def part(a: Column, d: Column, lo: Column) -> tuple[Column, Column]:
        # first and last share of a side between lo and lo + step
        t0, t1 = F.try_divide(lo - a, d), F.try_divide(lo + step - a, d)
        within = (a >= lo) & (a <= lo + step)
        return F.coalesce(F.least(t0, t1), F.when(within, 0.0), F.lit(2.0)), F.coalesce(F.greatest(t0, t1), F.when(within, 1.0), F.lit(-1.0))

    rows = s.withColumn("cy", F.explode(F.sequence(F.ceil(F.least("py", "qy") / step) - 1, F.floor(F.greatest("py", "qy") / step))))
    dx = F.col("qx") - F.col("px")
    b = part(F.col("py"), F.col("qy") - F.col("py"), F.col("cy") * step)
    rows = rows.withColumns({"_dx": dx, "_from": F.greatest(b[0], F.lit(0.0)), "_to": F.least(b[1], F.lit(1.0))}).filter("_from <= _to")
    x0, x1 = F.col("px") + F.col("_dx") * F.col("_from"), F.col("px") + F.col("_dx") * F.col("_to")
    cells = rows.withColumn("cx", F.explode(F.sequence(F.ceil(F.least(x0, x1) / step) - 2, F.floor(F.greatest(x0, x1) / step) + 1)))
    a = part(F.col("px"), F.col("_dx"), F.col("cx") * step)
    return cells.filter(F.greatest(a[0], F.col("_from")) <= F.least(a[1], F.col("_to"))).select("_key", "cx", "cy")
