"""Outer boundary of features that share vertices, as rings.

Sides that two features share cancel out; the rest are chained to rings with the
inside on their left, so outlines run counterclockwise and holes clockwise.
Places in a ring come from pointer jumping: after k rounds a side knows its next
2 ** k ones, so a ring of any length takes as many rounds as its length has bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.operators import sides as S
from landloom.sources.shared import written

_ENDS = ["px", "py", "qx", "qy"]


def turned(r: Column) -> Column:
    """Twice the area of a ring, positive if it runs counterclockwise; relative to its first point."""
    nxt = F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, 1, 1))
    x, y = F.get(r, 0)["x"], F.get(r, 0)["y"]
    cross = F.zip_with(r, nxt, lambda p, q: (p["x"] - x) * (q["y"] - y) - (q["x"] - x) * (p["y"] - y))
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)


def boundary_sides(features: DataFrame, rings: str = "rings") -> DataFrame:
    """Directed sides (id, px, py, qx, qy) of the union, the inside on the left; the first ring of a feature is its outline, others are holes.

    A side that runs both ways is inside and goes.  Equal features count once.
    """
    e = features.select(F.xxhash64(rings).alias("_key"), F.posexplode(rings).alias("_ring", "r"))
    right = (F.col("_ring") == 0) == (turned(F.col("r")) > 0)
    nxt = F.concat(F.slice("r", F.lit(2), F.size("r")), F.slice("r", 1, 1))
    s = e.withColumn("_right", right).select("_key", "_ring", "_right", F.posexplode(F.arrays_zip(F.col("r").alias("p"), nxt.alias("q"))).alias("_at", "s"))
    s = s.dropDuplicates(["_key", "_ring", "_at"]).filter("s.p <> s.q")
    way = F.when(F.col("_right") == (F.col("s.p") < F.col("s.q")), 1).otherwise(-1)
    net = s.select(F.least("s.p", "s.q").alias("a"), F.greatest("s.p", "s.q").alias("b"), way.alias("way")).groupBy("a", "b").agg(F.sum("way").alias("net")).filter("net <> 0")
    p, q = F.when(F.col("net") > 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("net") > 0, F.col("b")).otherwise(F.col("a"))
    flat = net.select(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy"))
    return flat.select(F.xxhash64(*_ENDS).alias("id"), *_ENDS)


def following(s: DataFrame) -> DataFrame:
    """(id, next): the side that bounds the same inside next.

    Where several sides begin at an end, it is the first one clockwise from the
    way back, so that parts that touch at a corner stay apart.
    """
    out = s.select(F.col("id").alias("next"), F.col("px").alias("qx"), F.col("py").alias("qy"), (F.col("qx") - F.col("px")).alias("ox"), (F.col("qy") - F.col("py")).alias("oy"))
    bx, by = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    angle = F.atan2(F.col("ox") * by - F.col("oy") * bx, F.col("ox") * bx + F.col("oy") * by)
    clockwise = F.when(angle <= 0, angle + 2 * math.pi).otherwise(angle)
    return s.join(out, ["qx", "qy"]).groupBy("id").agg(F.min_by("next", F.struct(clockwise, "next")).alias("next"))


def ranked(links: DataFrame) -> DataFrame:
    """(id, next) with ``ring``, the least id of the cycle, and ``ahead``, the steps to it."""
    now, width = written(links.select("id", "next", F.col("next").alias("to"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("ahead")), "rings"), 1
    while True:
        far = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
        nearer = F.col("_ring") < F.col("ring")
        step = now.join(far, "to").select("id", "next", F.col("_to").alias("to"), F.when(nearer, F.col("_ring")).otherwise(F.col("ring")).alias("ring"), F.when(nearer, F.col("_ahead") + width).otherwise(F.col("ahead")).alias("ahead"), nearer.alias("moved"))
        step = written(step, "rings")
        if step.filter("moved").isEmpty():
            return step.select("id", "next", "ring", "ahead")
        now, width = step.drop("moved"), 2 * width


def parted(s: DataFrame, found: DataFrame) -> DataFrame | None:
    """Links that part rings where they meet themselves at a corner; None if no ring does.

    Between two visits of a corner a ring is a ring of its own: the side that
    arrives is linked to the one that left at the visit before.
    """
    visits = found.join(s.select("id", "qx", "qy"), "id")
    at = ["ring", "qx", "qy"]
    if visits.groupBy(*at).count().filter("count > 1").isEmpty():
        return None
    order = Window.partitionBy(*at).orderBy(F.col("ahead") > 0, F.desc("ahead"))
    last = F.last("next").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return visits.select("id", F.coalesce(F.lag("next").over(order), last).alias("next"))


def boundary_rings(features: DataFrame, holes: bool = False, cell: float | None = None) -> DataFrame:
    """Corners of the outer boundary of features that share vertices: ring, part, hole, area, position, x, y.

    Every part of the union has one outline; positions run counterclockwise
    from 0 along it.  Holes are left out, as if filled, or come with ``holes``:
    clockwise, ``part`` being the ring of the part they are in, which is found
    in cells of size ``cell``.  Rings touch themselves and others at corners at
    most.  No features, or none with a surface, give no row.  Features must meet
    along whole sides: a side that another one only partly covers stays.
    """
    s = written(boundary_sides(features), "boundary")
    if not s.groupBy("id").count().filter("count > 1").isEmpty():
        raise RuntimeError("two sides of the boundary have the same hash")
    found = ranked(following(s))
    links = parted(s, found)
    if links is not None:
        found = ranked(links)
    rows = s.join(found.select("id", "ring", "ahead"), "id")
    first = rows.filter("ahead = 0").select("ring", F.col("px").alias("_x"), F.col("py").alias("_y"), ((F.col("px") + F.col("qx")) / 2).alias("x"), ((F.col("py") + F.col("qy")) / 2).alias("y"))
    rows = rows.join(first.select("ring", "_x", "_y"), "ring")
    cross = (F.col("px") - F.col("_x")) * (F.col("qy") - F.col("_y")) - (F.col("qx") - F.col("_x")) * (F.col("py") - F.col("_y"))
    sizes = written(rows.groupBy("ring").agg((F.sum(cross) / 2).alias("area"), F.count("*").alias("n")), "ring-sizes")
    kept = sizes.filter("area > 0").withColumn("part", F.col("ring"))
    if holes:
        outlines = rows.join(kept.select("ring"), "ring").select(F.col("ring").alias("_key"), *_ENDS)
        inner = first.join(sizes.filter("area < 0"), "ring").select("ring", "area", "n", "x", "y")
        if cell is None:
            box = s.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
            cell = max(box[1] - box[0], box[3] - box[2]) / 64 if box[0] is not None else 1.0
        around = S.holders(inner, outlines, cell).join(kept.select(F.col("ring").alias("_key"), F.col("area").alias("_size")), "_key")
        around = around.groupBy("ring", "area", "n").agg(F.min_by("_key", F.struct("_size", "_key")).alias("part"))
        kept = kept.unionByName(around.select(*kept.columns))
    out = rows.select("ring", "ahead", "px", "py").join(kept, "ring")
    position = F.when(F.col("ahead") == 0, 0).otherwise(F.col("n") - F.col("ahead"))
    return out.select("ring", "part", (F.col("area") < 0).alias("hole"), F.abs("area").alias("area"), position.cast("long").alias("position"), F.col("px").alias("x"), F.col("py").alias("y"))
