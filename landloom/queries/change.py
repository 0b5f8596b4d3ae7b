"""Queries of changes between two dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.functions import names
from landloom.functions.counter import mixed_sql
from landloom.functions.names import CLASS_NAMES
from landloom.operators import change as C
from landloom.operators import vector as V
from landloom.queries import query
from landloom.sources.derived import table

VALID = "(c1 BETWEEN 1 AND 10 AND c2 BETWEEN 1 AND 10)"
SCOPED = "(SELECT *, zone AS scope FROM {class_pair} UNION ALL SELECT *, 'all' AS scope FROM {class_pair})"
SCOPES = f"(SELECT DISTINCT scope FROM {SCOPED})"
TEN = "(SELECT CAST(unnest(range(1, 11)) AS INT) AS {})"
MATRIX = f"""(SELECT s.scope, a.c1, b.c2, coalesce(m.n, 0) AS n, a.c1 <> b.c2 AS changed FROM {SCOPES} s CROSS JOIN {TEN.format("c1")} a CROSS JOIN {TEN.format("c2")} b
 LEFT JOIN (SELECT scope, c1, c2, count(*) AS n FROM {SCOPED} WHERE {VALID} GROUP BY ALL) m ON m.scope = s.scope AND m.c1 = a.c1 AND m.c2 = b.c2)"""
FLAGS = [
    "c2 IN (1, 3)",
    "c2 = 2",
    "c2 IN (5, 6) OR (c2 = 4 AND c1 <> 6)",
    "c2 = 8 OR (c2 = 7 AND c1 <> 8)",
    "c2 = 9 OR (c2 = 5 AND c1 <> 9)",
    "c1 = 9 OR (c1 = 5 AND c2 <> 9)",
]
KEYS = list(C.FOCUS)
SHOWN = "CASE WHEN c1 = c2 THEN 0 WHEN {} THEN 1 ELSE 2 END"
FOCUS_LONG = " UNION ALL ".join(f"SELECT scope, '{k}' AS map_key, {SHOWN.format(f)} AS class_id FROM {SCOPED} WHERE {VALID}" for k, f in zip(KEYS, FLAGS, strict=True))
FOCUS_STATS = f"""(SELECT *, sum(n) OVER (PARTITION BY scope, map_key) AS valid, sum(CASE WHEN class_id > 0 THEN n ELSE 0 END) OVER (PARTITION BY scope, map_key) AS changed FROM (
 SELECT s.scope, k.map_key, c.class_id, count(f.scope) AS n FROM {SCOPES} s CROSS JOIN (SELECT unnest({KEYS}) AS map_key) k CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INT) AS class_id) c
 LEFT JOIN ({FOCUS_LONG}) f ON f.scope = s.scope AND f.map_key = k.map_key AND f.class_id = c.class_id GROUP BY ALL))"""
GROUP = """CASE WHEN c1 = c2 THEN 0 WHEN c2 IN (1, 3) THEN 1 WHEN c2 = 2 THEN 2 WHEN c2 IN (7, 8) THEN 4 WHEN c2 = 9 THEN 5
 WHEN c1 = 9 OR (c1 = 5 AND c2 NOT IN (5, 9)) THEN 6 WHEN c2 IN (5, 6) OR (c2 = 4 AND c1 <> 6) THEN 3 ELSE 7 END"""
RECIPROCAL = {"ecology": (FLAGS[5], FLAGS[4]), "water": (FLAGS[3], "c1 = 8 OR (c1 = 7 AND c2 <> 8)")}


def pairs(spark, d):
    return table(spark, d, "class_pair")


@query(f"SELECT px_row, px_col, part, {VALID} IS TRUE AS valid, ({VALID} AND c1 <> c2) IS TRUE AS changed FROM {{class_pair}}")
def p21_change_flag(spark, d):
    return pairs(spark, d).select("px_row", "px_col", "part", C.valid().alias("valid"), C.changed().alias("changed"))


@query("SELECT px_row, px_col, part, round(CASE WHEN u1 IS NOT NULL AND u2 IS NOT NULL THEN (u1 + u2) / 2 END, 6) AS u_mean, CASE WHEN u1 IS NOT NULL AND u2 IS NOT NULL THEN greatest(u1, u2) END AS u_max FROM {class_pair}")
def p22_pairwise_uncertainty(spark, d):
    return C.pairwise_uncertainty(pairs(spark, d)).select("px_row", "px_col", "part", F.round("u_mean", 6).alias("u_mean"), "u_max")


@query("SELECT px_row, px_col, part, c1 * 100 + c2 AS code, c1 AS from_class, c2 AS to_class FROM {class_pair}")
def p23_transition_code(spark, d):
    coded = pairs(spark, d).select("px_row", "px_col", "part", names.transition_code("c1", "c2").alias("code"))
    return coded.withColumns({"from_class": F.expr("cast(code div 100 as int)"), "to_class": F.col("code") % 100})


@query("SELECT px_row, px_col, part, " + ", ".join(f"({VALID} AND c1 <> c2 AND ({f})) IS TRUE AS {k}" for k, f in zip(KEYS, FLAGS, strict=True)) + f", CASE WHEN {VALID} THEN {SHOWN.format(FLAGS[0])} END AS map1_code FROM {{class_pair}}")
def p24_focus_flags(spark, d):
    flags = C.focus_flags()
    return pairs(spark, d).select("px_row", "px_col", "part", *(f.alias(k) for k, f in flags.items()), C.display_code(flags[KEYS[0]]).alias("map1_code"))


@query(f"SELECT px_row, px_col, part, CASE WHEN {VALID} THEN {GROUP} END AS grp FROM {{class_pair}}")
def p25_change_group(spark, d):
    return pairs(spark, d).select("px_row", "px_col", "part", C.change_group().alias("grp"))


def _category(kind: str) -> str:
    first, second = RECIPROCAL[kind]
    return f"CASE WHEN c1 = c2 THEN 0 WHEN {first} THEN 1 WHEN {second} THEN 2 ELSE 3 END"


@query(f"SELECT px_row, px_col, part, CASE WHEN {VALID} THEN {_category('ecology')} END AS ecology, CASE WHEN {VALID} THEN {_category('water')} END AS water FROM {{class_pair}}")
def p26_reciprocal(spark, d):
    return pairs(spark, d).select("px_row", "px_col", "part", *(C.reciprocal_category(k).alias(k) for k in RECIPROCAL))


TOP = f"SELECT code, n FROM (SELECT c1 * 100 + c2 AS code, count(*) AS n FROM {{class_pair}} WHERE {VALID} AND c1 <> c2 GROUP BY 1) ORDER BY n DESC, code LIMIT 9"


@query(f"""SELECT px_row, px_col, part, p.code, CAST(CASE WHEN c1 = c2 THEN 0 WHEN t.rank IS NULL THEN 1 ELSE t.rank + 1 END AS INT) AS preview FROM (SELECT *, c1 * 100 + c2 AS code FROM {{class_pair}} WHERE {VALID}) p
 LEFT JOIN (SELECT code, row_number() OVER (ORDER BY n DESC, code) AS rank FROM ({TOP})) t ON p.code = t.code""")
def p27_preview_class(spark, d):
    return C.preview_class(pairs(spark, d), 9).select("px_row", "px_col", "part", "code", "preview")


@query("""SELECT a.px_row, a.px_col, a.class_id AS c1, a.uncertainty AS u1, b.class_id AS c2, b.uncertainty AS u2 FROM {class_year} a JOIN {class_year} b
 ON a.px_row = b.px_row AND a.px_col = b.px_col AND a.year = 2017 AND b.year = 2024""")
def j02_two_dates(spark, d):
    return C.both_years(table(spark, d, "class_year"))


@query(f"SELECT scope, c1, c2, n, changed FROM {MATRIX}")
def j14_a03_transition_matrix(spark, d):
    return C.transition_matrix(pairs(spark, d))


NAMES = "CASE {} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CLASS_NAMES.items()) + " END"


@query(f"""SELECT scope, c1, c2, n, changed, round(n * 100.0 / sum(n) OVER (PARTITION BY scope), 6) AS pct_scope,
 round(coalesce(n * 100.0 / nullif(sum(n) OVER (PARTITION BY scope, c1), 0), 0), 6) AS pct_from, round(coalesce(n * 100.0 / nullif(sum(n) OVER (PARTITION BY scope, c2), 0), 0), 6) AS pct_to,
 {NAMES.format("c1")} AS from_name, {NAMES.format("c2")} AS to_name FROM {MATRIX}""")
def a05_transition_shares(spark, d):
    s = C.transition_shares(pairs(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("pct_scope", "pct_from", "pct_to")})


@query(f"""SELECT s.scope, y.year, c.class_id, count(p.scope) AS n, count(p.scope) * 100.0::DOUBLE AS area_m2, count(p.scope) * 100.0::DOUBLE / 1e6 AS area_km2
 FROM {SCOPES} s CROSS JOIN (SELECT CAST(unnest([2017, 2024]) AS INT) AS year) y CROSS JOIN {TEN.format("class_id")} c
 LEFT JOIN (SELECT scope, 2017 AS year, c1 AS class_id FROM {SCOPED} UNION ALL SELECT scope, 2024, c2 FROM {SCOPED}) p ON p.scope = s.scope AND p.year = y.year AND p.class_id = c.class_id GROUP BY ALL""")
def a01_class_areas(spark, d):
    return C.class_areas(pairs(spark, d))


@query(f"""SELECT scope, count(*) FILTER ({VALID}) AS valid, count(*) FILTER ({VALID} AND c1 <> c2) AS changed, count(*) FILTER ({VALID} AND c1 = c2) AS unchanged,
 count(*) FILTER ({VALID} AND c1 <> c2) * 100.0::DOUBLE / 1e6 AS changed_km2, count(*) FILTER ({VALID}) * 100.0::DOUBLE / 1e6 AS valid_km2,
 round(count(*) FILTER ({VALID} AND c1 <> c2) / count(*) FILTER ({VALID}), 9) AS fraction FROM {SCOPED} GROUP BY scope""")
def a02_change_summary(spark, d):
    return C.change_summary(pairs(spark, d)).withColumn("fraction", F.round("fraction", 9))


_U = {"u1": (VALID, "u1"), "u2": (VALID, "u2"), "pair_mean": (VALID, "um"), "pair_max": (VALID, "ux"), "changed": (f"{VALID} AND c1 <> c2", "um"), "unchanged": (f"{VALID} AND c1 = c2", "um")}


@query("SELECT scope, " + ", ".join(f"round(avg({c}) FILTER ({w}), 6) AS avg_{k}, count({c}) FILTER ({w}) AS n_{k}" for k, (w, c) in _U.items()) + f" FROM (SELECT *, CASE WHEN u1 IS NOT NULL AND u2 IS NOT NULL THEN (u1 + u2) / 2 END AS um, CASE WHEN u1 IS NOT NULL AND u2 IS NOT NULL THEN greatest(u1, u2) END AS ux FROM {SCOPED}) GROUP BY scope")
def a04_uncertainty_summary(spark, d):
    s = C.uncertainty_summary(pairs(spark, d))
    return s.select("scope", *(F.round(c, 6).alias(c) if c.startswith("avg") else F.col(c) for c in s.columns if c != "scope"))


REGION = "px_row % 100 BETWEEN 20 AND 59"


@query(f"""SELECT c1, c2, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM {{class_pair}} WHERE {REGION} AND {VALID} GROUP BY c1, c2""")
def a06_region_transitions(spark, d):
    p = pairs(spark, d).withColumns({"x": F.col("px_col").cast("double"), "y": F.col("px_row").cast("double")})
    # the region is one of parts: a band across every hundred rows of the map
    bands = p.select(F.expr("px_row div 100").alias("feature_id")).distinct()
    edge = {"x0": F.lit(0.5), "y0": F.col("feature_id") * 100 + 19.5, "x1": F.lit(7.5), "y1": F.col("feature_id") * 100 + 59.5}
    region = bands.withColumns(edge).select("feature_id", V.rectangle("x0", "y0", "x1", "y1").alias("rings"))
    inside = V.pixels_in(p, region, 100.0, "left_semi").drop("x", "y").withColumn("zone", F.lit("region"))
    return C.transition_shares(inside).filter("scope = 'region' and n > 0").select("c1", "c2", "n", F.round("pct_scope", 6).alias("pct"))


@query(f"""SELECT scope, map_key, class_id, n, n * 100.0::DOUBLE / 1e6 AS area_km2, round(n * 100.0 / valid, 6) AS pct_valid, round(CASE WHEN class_id > 0 THEN n * 100.0 / changed ELSE 0 END, 6) AS pct_changed,
 CAST(valid AS BIGINT) AS valid, CAST(changed AS BIGINT) AS changed FROM {FOCUS_STATS}""")
def a07_focus_statistics(spark, d):
    return C.focus_statistics(pairs(spark, d)).withColumns({c: F.round(c, 6) for c in ("pct_valid", "pct_changed")})


_FOCUS_ROWS = f"(SELECT map_key, round(n * 100.0::DOUBLE / 1e6, 4) AS area_km2, round(n * 100.0::DOUBLE / valid, 4) AS pct_valid, round(n * 100.0::DOUBLE / changed, 4) AS pct_changed, round(valid * 100.0::DOUBLE / 1e6, 4) AS valid_km2 FROM {FOCUS_STATS} WHERE scope = 'all' AND class_id = 1)"


@query(f"SELECT * FROM {_FOCUS_ROWS} UNION ALL SELECT 'TOTAL', round(sum(area_km2), 4), round(sum(pct_valid), 4), round(sum(pct_changed), 4), max(valid_km2) FROM {_FOCUS_ROWS}")
def a08_focus_totals(spark, d):
    return C.focus_totals(pairs(spark, d))


@query(f"SELECT scope, {GROUP} AS grp, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY scope), 6) AS pct FROM {SCOPED} WHERE {VALID} GROUP BY 1, 2")
def a09_group_statistics(spark, d):
    return C.group_statistics(pairs(spark, d)).withColumn("pct", F.round("pct", 6))


def _reciprocal_sql(kind: str) -> str:
    p = f"(SELECT scope, {_category(kind)} AS category, c1, c2 FROM {SCOPED} WHERE {VALID})"
    return f"""SELECT scope, 'category' AS row_type, category, CAST(NULL AS INT) AS c1, CAST(NULL AS INT) AS c2, count(*) AS n FROM {p} GROUP BY scope, category
 UNION ALL SELECT scope, 'net', NULL, NULL, NULL, CAST(count(*) FILTER (category = 2) - count(*) FILTER (category = 1) AS BIGINT) FROM {p} GROUP BY scope
 UNION ALL SELECT scope, 'transition', category, c1, c2, count(*) FROM {p} WHERE category IN (1, 2) GROUP BY scope, category, c1, c2"""


@query(_reciprocal_sql("ecology"))
def a10_reciprocal_ecology(spark, d):
    return C.reciprocal_statistics(pairs(spark, d), "ecology")


@query(_reciprocal_sql("water"))
def a10_reciprocal_water(spark, d):
    return C.reciprocal_statistics(pairs(spark, d), "water")


@query(f"SELECT c1 * 100 + c2 AS code, count(*) AS n FROM {{class_pair}} WHERE {VALID} GROUP BY 1")
def a44_code_counts(spark, d):
    return C.code_counts(pairs(spark, d))


@query(TOP)
def t04_top_changes(spark, d):
    return C.top_changes(pairs(spark, d), 9)


@query(f"SELECT CAST(floor(px_row / 512) AS BIGINT) AS win, count(*) FILTER ({VALID}) AS valid, count(*) FILTER ({VALID} AND c1 <> c2) AS changed FROM {{class_pair}} GROUP BY 1")
def a52_window_counts(spark, d):
    return C.window_counts(pairs(spark, d), 512)


@query(f"""SELECT win, valid, changed FROM (SELECT CAST(floor(px_row / 512) AS BIGINT) AS win, count(*) FILTER ({VALID}) AS valid, count(*) FILTER ({VALID} AND c1 <> c2) AS changed
 FROM {{class_pair}} GROUP BY 1) WHERE valid > 0 ORDER BY changed = 0, {mixed_sql(42, 'win')}, win LIMIT 4""")
def g37_changed_windows(spark, d):
    return C.changed_windows(pairs(spark, d), 512, 4, 42)
