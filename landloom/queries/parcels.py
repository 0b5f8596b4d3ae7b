"""Queries of polygons, zones and parcels."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.functions.recode import recoded
from landloom.operators import boundary as B
from landloom.operators import parcels as A
from landloom.operators import vector as V
from landloom.queries import query
from landloom.queries.accuracy import rounded
from landloom.queries.projections import RECODED
from landloom.sources.derived import table

#: Pixels of the embeddings grid at their centres.
POINTS = "(SELECT sample_id, class_id, px_col + 0.5 AS x, px_row + 0.5 AS y FROM {ae_pixels})"
IN_ZONE = f"(SELECT p.*, z.zone, z.zone_id FROM {POINTS} p JOIN {{zones}} z ON p.x > z.x0 AND p.x < z.x1 AND p.y > z.y0 AND p.y < z.y1)"
#: Rectangles with a hole, one for each customer.
PLOTS = "(SELECT c_custkey AS feature_id, c_custkey % 30 * 4.0 AS x0, CAST(floor(c_custkey / 30) AS INT) * 4.0 AS y0, 3 + c_custkey % 2 AS w, CAST(c_nationkey % 10 + 1 AS INT) AS class_id FROM {customer})"


def points(spark, d):
    return table(spark, d, "ae_pixels").select("sample_id", "class_id", (F.col("px_col") + 0.5).alias("x"), (F.col("px_row") + 0.5).alias("y"))


def zones(spark, d):
    return table(spark, d, "zones").select(F.col("zone_id").alias("feature_id"), "zone", V.rectangle("x0", "y0", "x1", "y1").alias("rings"))


def plots(spark, d, hole: bool = False):
    c = table(spark, d, "customer").withColumns({"x0": F.col("c_custkey") % 30 * 4.0, "y0": F.floor(F.col("c_custkey") / 30) * 4.0})
    c = c.withColumns({"x1": F.col("x0") + 3 + F.col("c_custkey") % 2, "y1": F.col("y0") + 4.0, "hx0": F.col("x0") + 1, "hy0": F.col("y0") + 1, "hx1": F.col("x0") + 2, "hy1": F.col("y0") + 2})
    rings = V.rectangle("x0", "y0", "x1", "y1")
    if hole:
        rings = F.concat(rings, V.rectangle("hx0", "hy0", "hx1", "hy1"))
    return c.select(F.col("c_custkey").alias("feature_id"), (F.col("c_nationkey") % 10 + 1).alias("class_id"), rings.alias("rings"))


@query(f"SELECT feature_id, (w * 4 - 1)::DOUBLE AS area_m2, (w * 4 - 1) / 1e6 AS area_km2, (w * 4 - 1) / 1e4 AS area_ha, round((w * 4 - 1) / 4046.8564224, 9) AS area_acre FROM {PLOTS}")
def g18_polygon_area(spark, d):
    return rounded(plots(spark, d, True).select("feature_id", *(v.alias(k) for k, v in V.polygon_area().items())), "area_acre", digits=9)


@query(f"SELECT min(x0)::DOUBLE AS minx, min(y0)::DOUBLE AS miny, max(x0 + w)::DOUBLE AS maxx, max(y0 + 4)::DOUBLE AS maxy FROM {PLOTS}")
def g19_layer_extent(spark, d):
    return V.extent(plots(spark, d))


_SIDES = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS x0, {b}::DOUBLE AS y0, {c}::DOUBLE AS x1, {e}::DOUBLE AS y1 FROM {PLOTS}" for a, b, c, e in (("x0", "y0", "x0 + w", "y0"), ("x0", "y0 + 4", "x0 + w", "y0 + 4"), ("x0", "y0", "x0", "y0 + 4"), ("x0 + w", "y0", "x0 + w", "y0 + 4")))


@query(f"SELECT x0, y0, x1, y1 FROM ({_SIDES}) GROUP BY ALL HAVING count(*) = 1")
def g20_dissolved_boundary(spark, d):
    return V.dissolved_edges(plots(spark, d))


_WAYS = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS px, {b}::DOUBLE AS py, {c}::DOUBLE AS qx, {e}::DOUBLE AS qy FROM {PLOTS}" for a, b, c, e in (("x0", "y0", "x0 + w", "y0"), ("x0 + w", "y0", "x0 + w", "y0 + 4"), ("x0 + w", "y0 + 4", "x0", "y0 + 4"), ("x0", "y0 + 4", "x0", "y0")))


@query(f"""WITH RECURSIVE ways AS ({_WAYS}), s AS (SELECT * FROM ways a WHERE NOT EXISTS (SELECT 1 FROM ways b WHERE a.px = b.qx AND a.py = b.qy AND a.qx = b.px AND a.qy = b.py)),
 walk AS (SELECT px AS x, py AS y, * FROM s UNION ALL SELECT w.x, w.y, n.* FROM walk w JOIN s n ON n.px = w.qx AND n.py = w.qy WHERE w.qx <> w.x OR w.qy <> w.y)
 SELECT x, y, sum(px * qy - qx * py) / 2 AS area, count(*) AS corners FROM walk GROUP BY x, y HAVING area > 0""")
def g20_outer_boundary(spark, d):
    rings = B.boundary_rings(plots(spark, d))
    return rings.join(rings.groupBy("ring").agg(F.count("*").alias("corners")), "ring").select("x", "y", "area", "corners")


@query("SELECT c_custkey, sha1(concat(c_name, c_mktsegment)) AS key FROM {customer}")
def g21_geometry_fingerprint(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat("c_name", "c_mktsegment").cast("binary").alias("wkb")).select("c_custkey", V.fingerprint("wkb").alias("key"))


@query(f"SELECT sample_id, max(zone_id) AS feature_id FROM {IN_ZONE} GROUP BY 1")
def g22_zone_of_pixel(spark, d):
    return V.zone_of_pixels(points(spark, d), zones(spark, d), ["sample_id"], 4.0)


@query(f"SELECT sample_id, zone FROM {IN_ZONE}")
def g23_j07_pixels_in_zones(spark, d):
    return V.pixels_in(points(spark, d), zones(spark, d), 4.0).select("sample_id", "zone")


@query(f"SELECT CAST(x0 + i AS BIGINT) AS cx, CAST(y0 + j AS BIGINT) AS cy, class_id FROM {PLOTS}, range(0, 4) a(i), range(0, 4) b(j) WHERE i < w AND NOT (i = 1 AND j = 1)")
def g24_burned_labels(spark, d):
    return V.burned(plots(spark, d, True), 1.0)


@query(f"SELECT feature_id, CAST(x0 + i AS BIGINT) AS cx, CAST(y0 + j AS BIGINT) AS cy FROM {PLOTS}, range(0, 4) a(i), range(0, 4) b(j) WHERE i < w")
def g25_touched_cells(spark, d):
    return V.touched(plots(spark, d), 1.0)


@query(f"SELECT feature_id FROM {PLOTS} WHERE feature_id % 9 <> 0 AND feature_id % 5 <> 0")
def s03_sound_features(spark, d):
    none = F.when(F.col("feature_id") % 9 == 0, None).when(F.col("feature_id") % 5 == 0, F.slice("rings", 1, 0)).otherwise(F.col("rings"))
    return V.sound_features(plots(spark, d).withColumn("rings", none)).select("feature_id")


@query(f"SELECT zone, class_id, count(*) AS n, round(count(*) * 0.01, 6)::DOUBLE AS area_ha, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY zone), 6) AS pct_zone, CAST(sum(count(*)) OVER (PARTITION BY zone) AS BIGINT) AS zone_n FROM {IN_ZONE} GROUP BY 1, 2")
def a16_zone_areas(spark, d):
    return rounded(A.zone_areas(V.pixels_in(points(spark, d), zones(spark, d), 4.0), 100.0), "pct_zone", "area_ha")


@query(f"""SELECT z.zone, CAST(coalesce(m.class_id, 0) AS INT) AS class_id, CAST(coalesce(m.n, 0) AS BIGINT) AS major_px, CAST(coalesce(m.total, 0) AS BIGINT) AS valid_px, round(coalesce(m.n / m.total, 0), 6) AS major_frac
 FROM {{zones}} z LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, class_id) AS r, sum(n) OVER (PARTITION BY zone) AS total FROM (SELECT zone, class_id, count(*) AS n FROM {IN_ZONE} GROUP BY 1, 2)) m ON m.zone = z.zone AND m.r = 1""")
def a17_parcel_majority(spark, d):
    z = zones(spark, d)
    return rounded(A.majority(V.pixels_in(points(spark, d), z, 4.0), z, "zone"), "major_frac")


PY = "{parcel_year}"


@query(f"SELECT kind, year, class_id, round(sum(area_m2), 2) AS area_m2, count(*) AS n FROM {PY} GROUP BY ALL")
def a18_parcel_areas(spark, d):
    return rounded(A.area_by(table(spark, d, "parcel_year"), ["kind", "year", "class_id"]), "area_m2", digits=2)


@query("SELECT maj, sub, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY maj), 2) AS pct FROM {landuse} GROUP BY 1, 2")
def a38_use_frequency(spark, d):
    return A.use_frequency(table(spark, d, "landuse"))


@query("SELECT 'maj' AS \"column\", maj AS value, count(*) AS n FROM {landuse} GROUP BY 2 UNION ALL SELECT 'sub', sub, count(*) FROM {landuse} GROUP BY 2")
def a39_value_counts(spark, d):
    return A.value_counts(table(spark, d, "landuse"), ["maj", "sub"])


@query(f"SELECT class_id, count(*) AS n FROM {RECODED} GROUP BY 1")
def a40_recoded_distribution(spark, d):
    return recoded(table(spark, d, "landuse")).groupBy("class_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


_TOPK = f"(SELECT kind, sum(area_m2) AS a, row_number() OVER (ORDER BY sum(area_m2) DESC, kind) AS place FROM {PY} GROUP BY 1)"


@query(f"SELECT CAST(place AS INT) AS place, kind, class_id, round(sum(area_m2), 2) AS area_m2, count(*) AS n FROM {PY} JOIN (SELECT kind, place FROM {_TOPK} WHERE place <= 3) USING (kind) GROUP BY ALL")
def a51_kind_profile(spark, d):
    return rounded(A.kind_profile(table(spark, d, "parcel_year"), 3), "area_m2", digits=2)


@query(f"SELECT kind, round(sum(area_m2), 2) AS area_m2, count(*) AS n FROM {PY} GROUP BY 1 ORDER BY sum(area_m2) DESC, kind LIMIT 3")
def t03_top_kinds(spark, d):
    return rounded(A.top_kinds(table(spark, d, "parcel_year"), 3), "area_m2", digits=2)


@query(f"""SELECT parcel, a.class_id AS class_1, b.class_id AS class_2, a.class_id <> b.class_id AS changed, concat(a.class_id, '_', b.class_id) AS code, concat(a.class_id, ' -> ', b.class_id) AS label, round(b.area_m2 - a.area_m2, 4) AS area_diff
 FROM {PY} a JOIN {PY} b USING (parcel) WHERE a.year = 2017 AND b.year = 2024""")
def j04_p36_parcel_change(spark, d):
    return rounded(A.parcel_change(table(spark, d, "parcel_year"), "parcel", 2017, 2024).select("parcel", "class_1", "class_2", "changed", "code", "label", "area_diff"), "area_diff", digits=4)


@query(f"SELECT 'parcel' AS \"column\", CAST(count(*) AS BIGINT) AS rows, true AS usable FROM {PY} UNION ALL SELECT 'kind', count(*), false FROM {PY}")
def j05_key_quality(spark, d):
    p = table(spark, d, "parcel_year")
    return A.key_quality(p.filter("year = 2017"), p.filter("year = 2024"), ["parcel", "kind"])


@query(f"SELECT parcel, year, class_id FROM {PY}")
def j06_collapsed_fields(spark, d):
    p = table(spark, d, "parcel_year").select("parcel", "year", "class_id").withColumn("class_id_y", F.col("class_id"))
    return A.collapsed(p, [("class_id", "class_id_y")])


@query(f"SELECT parcel, year, CASE kind WHEN '5-LOW' THEN 'low' WHEN '1-URGENT' THEN 'urgent' ELSE coalesce(kind, 'Unknown') END AS kind FROM {PY} WHERE area_m2 > 0")
def p38_cleaned_parcels(spark, d):
    return A.cleaned(table(spark, d, "parcel_year"), {"5-LOW": "low", "1-URGENT": "urgent"}).select("parcel", "year", "kind")


# The series of the transverse Mercator projection on the ellipsoid of WGS 84, to the sixth order, step by step.
_UTM = """WITH c AS (SELECT c_custkey, 90.0::DOUBLE + c_custkey % 60 / 10.0::DOUBLE AS lon, 20.0::DOUBLE + c_nationkey / 5.0::DOUBLE AS lat FROM {customer}),
 k AS (SELECT *, 6378137.0::DOUBLE AS a, 0.9996::DOUBLE AS k0, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM c),
 p AS (SELECT *, e2 / (1 - e2) AS ep, radians(lat) AS phi, radians(lon - 93) AS lam FROM k),
 q AS (SELECT *, a / sqrt(1 - e2 * sin(phi) ** 2) AS n, tan(phi) ** 2 AS t, ep * cos(phi) ** 2 AS cc, cos(phi) * lam AS w,
  a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - 35 * e2 ** 3 / 3072 * sin(6 * phi)) AS m FROM p),
 u AS (SELECT *, 500000 + k0 * n * (w + (1 - t + cc) * w ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * cc - 58 * ep) * w ** 5 / 120) AS easting,
  k0 * (m + n * tan(phi) * (w ** 2 / 2 + (5 - t + 9 * cc + 4 * cc ** 2) * w ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * cc - 330 * ep) * w ** 6 / 720)) AS northing FROM q)"""


@query(f"{_UTM} SELECT c_custkey, lon, lat, round(easting, 4) AS easting, round(northing, 4) AS northing, round(lon, 7) AS lon_back, round(lat, 7) AS lat_back FROM u")
def g14_utm_round_trip(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (90.0 + F.col("c_custkey") % 60 / 10.0).alias("lon"), (20.0 + F.col("c_nationkey") / 5.0).alias("lat"))
    u = c.withColumns(V.to_utm(F.col("lon"), F.col("lat")))
    back = V.from_utm(F.col("easting"), F.col("northing"))
    both = u.withColumns({f"{k}_back": v for k, v in back.items()})
    return rounded(rounded(both, "easting", "northing", digits=4), "lon_back", "lat_back", digits=7)
