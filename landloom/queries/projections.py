"""Queries of pixel-wise projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.functions import indices as I
from landloom.functions import names as N
from landloom.functions.recode import MAJOR, PAIRS, recoded
from landloom.functions.rounding import scaled_round
from landloom.operators import grid as G
from landloom.operators import pixels as P
from landloom.queries import query
from landloom.sources.derived import table
from landloom.sources.tables import flattened

BANDS = "(SELECT px_row, px_col, part, " + ", ".join(f"nullif({b}, 65535)::DOUBLE AS {b}" for b in ("b2", "b3", "b4", "b8", "b11", "b12")) + " FROM {band_pixels})"
ND = "({a} - {b}) / nullif({a} + {b}, 0)"


def _index(name: str, sql: str):
    def run(spark, d):
        return table(spark, d, "band_pixels").select("px_row", "px_col", "part", I.all_indices()[name].alias(name))

    run.__name__ = f"p{I.INDEX_NAMES_TO_IDS[name]}_{name}"
    query(f"SELECT px_row, px_col, part, {sql} AS {name} FROM {BANDS}")(run)


R = {b: f"({b} * 0.0001::DOUBLE)" for b in ("b2", "b3", "b4", "b8", "b11", "b12")}
_EVI_DEN = f"({R['b8']} + 6.0::DOUBLE * {R['b4']} - 7.5::DOUBLE * {R['b2']} + 1.0::DOUBLE)"
_EVI = f"(2.5::DOUBLE * ({R['b8']} - {R['b4']}) / {_EVI_DEN})"
_index("ndvi", ND.format(a="b8", b="b4"))
_index("evi", f"CASE WHEN {R['b2']} BETWEEN 0 AND 2 AND {R['b4']} BETWEEN 0 AND 2 AND {R['b8']} BETWEEN 0 AND 2 AND {_EVI_DEN} > 1e-6 AND {_EVI} BETWEEN -2 AND 2 THEN {_EVI} END")
_index("msavi", f"(2.0::DOUBLE * {R['b8']} + 1 - sqrt(greatest((2.0::DOUBLE * {R['b8']} + 1) * (2.0::DOUBLE * {R['b8']} + 1) - 8 * ({R['b8']} - {R['b4']}), 0))) / 2 * CASE WHEN b8 IS NULL OR b4 IS NULL THEN NULL ELSE 1 END")
_index("ndmi", ND.format(a="b8", b="b11"))
_index("ndwi", ND.format(a="b3", b="b8"))
_index("ndpi", ND.format(a="b11", b="b3"))
_index("ndbi", ND.format(a="b11", b="b8"))
_index("bsi", ND.format(a="(b11 + b4)", b="(b8 + b2)"))
_index("nirv", f"{ND.format(a='b8', b='b4')} * {R['b8']}")
_index("awei_sh", f"{R['b2']} + 2.5 * {R['b3']} - 1.5 * ({R['b8']} + {R['b11']}) - 0.25 * {R['b12']}")

HOLES = "(SELECT *, CASE WHEN sample_id % 11 = 0 THEN list_transform(ae, lambda x: 0::FLOAT) WHEN sample_id % 7 = 0 THEN list_concat([0::FLOAT], ae[2:]) ELSE ae END AS holed FROM {ae_pixels})"


def holed(spark, d):
    zero = F.lit(0).cast("float")
    return table(spark, d, "ae_pixels").withColumn("holed", F.when(F.col("sample_id") % 11 == 0, F.transform("ae", lambda x: zero)).when(F.col("sample_id") % 7 == 0, F.concat(F.array(zero), F.slice("ae", 2, 63))).otherwise(F.col("ae")))


@query(f"SELECT sample_id, len(list_filter(holed, lambda x: x = 0)) = 0 AS all_bands, len(list_filter(holed, lambda x: x <> 0)) > 0 AS any_band, len(list_filter(holed, lambda x: x <> 0)) >= 60 AS most_bands FROM {HOLES}")
def p11_p12_p13_embedding_validity(spark, d):
    return holed(spark, d).select("sample_id", P.all_bands("holed").alias("all_bands"), P.any_band("holed").alias("any_band"), P.at_least_bands(60, "holed").alias("most_bands"))


@query("SELECT px_row, px_col, part, c1 FROM {class_pair} WHERE c1 BETWEEN 1 AND 10")
def p14_labelled(spark, d):
    return table(spark, d, "class_pair").filter(P.labelled("c1")).select("px_row", "px_col", "part", "c1")


@query(f"SELECT px_row, px_col, part FROM {BANDS} WHERE b8 IS NOT NULL AND b8 + b4 <> 0 AND b8 + b11 <> 0 AND b3 + b8 <> 0 AND b11 + b3 <> 0")
def p15_known_indices(spark, d):
    some = {k: v for k, v in I.all_indices().items() if k in ("ndvi", "ndmi", "ndwi", "ndpi", "ndbi")}
    return P.known(table(spark, d, "band_pixels"), some).select("px_row", "px_col", "part")


_IDX = [f"i{k}" for k in range(10)]


@query("SELECT sample_id, 74 AS n, round(list_sum(list_transform(ae, lambda x: x::DOUBLE)) + (sample_id % 13) * 45, 6) AS total FROM {ae_pixels}")
def p16_fused_features(spark, d):
    p = table(spark, d, "ae_pixels").withColumns({c: (F.col("sample_id") % 13) * k for k, c in enumerate(_IDX)})
    return P.fused(p, _IDX).select("sample_id", F.size("features").alias("n"), scaled_round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_U = "xor(xor(px_row // 5 * 73856093, px_col // 5 * 19349663), 42::BIGINT * 83492791) % 10000000 / 10000000.0::DOUBLE"


@query(f"SELECT sample_id, CASE WHEN {_U} < 0.15 THEN 'test' WHEN {_U} < 0.3 THEN 'val' ELSE 'train' END AS split, CASE WHEN {_U} < 0.2 THEN 'val' ELSE 'train' END AS two_way FROM {{ae_pixels}}")
def p17_p40_split(spark, d):
    u = G.block_fraction(42)
    return G.with_blocks(table(spark, d, "ae_pixels"), 5).select("sample_id", P.split_of(u, 0.15, 0.15).alias("split"), P.two_way_split(u, 0.2).alias("two_way"))


@query("SELECT sample_id, list_transform(ae, lambda x: round((x::DOUBLE - 0.125) / 0.25, 6)) AS z FROM {ae_pixels}")
def p18_standardised(spark, d):
    mu, sigma = (F.array_repeat(F.lit(v), F.size("ae")) for v in (0.125, 0.25))
    return table(spark, d, "ae_pixels").select("sample_id", F.transform(P.standardised("ae", mu, sigma), lambda x: scaled_round(x)).alias("z"))


_TEN = "list_transform(ae[1:10], lambda x: exp(x::DOUBLE * 8 - list_max(ae[1:10])::DOUBLE * 8))"


@query(f"SELECT sample_id, CAST(list_position(ae[1:10], list_max(ae[1:10])) AS INT) AS class_id, round(1 / list_sum({_TEN}), 6) AS confidence, round(1 - 1 / list_sum({_TEN}), 6) AS uncertainty, round((1 - list_reverse_sort({_TEN})[2]) / list_sum({_TEN}), 6) AS margin FROM {{ae_pixels}}")
def p19_p20_f17_predicted_class(spark, d):
    p = table(spark, d, "ae_pixels").withColumn("p", N.softmax(F.transform(F.slice("ae", 1, 10), lambda x: x.cast("double") * 8)))
    top = F.array_max("p")
    ranked = F.sort_array("p", asc=False)
    return p.select("sample_id", N.argmax("p").alias("class_id"), F.round(top, 6).alias("confidence"), F.round(1 - top, 6).alias("uncertainty"), F.round(ranked[0] - ranked[1], 6).alias("margin"))


def _case(column: str, legend: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in legend.items()) + " ELSE 0 END"


_HARM = f"(SELECT px_row, px_col, part, {_case('dw', N.DYNAMICWORLD)} AS dw, {_case('jaxa', N.JAXA)} AS jaxa, {_case('hr', N.HIGH_RESOLUTION)} AS hr, study FROM {{map_stack}})"


def harmonised(spark, d):
    return table(spark, d, "map_stack").withColumns({"dw": N.harmonised("dw", N.DYNAMICWORLD), "jaxa": N.harmonised("jaxa", N.JAXA), "hr": N.harmonised("hr", N.HIGH_RESOLUTION)})


@query(f"SELECT px_row, px_col, part, dw, jaxa, hr FROM {_HARM}")
def p28_harmonised_legends(spark, d):
    return harmonised(spark, d).select("px_row", "px_col", "part", "dw", "jaxa", "hr")


@query(f"SELECT px_row, px_col, part, dw > 0 AND jaxa > 0 AND hr > 0 AND study > 0 AS valid_all, dw > 0 AND jaxa > 0 AND hr > 0 AND study > 0 AND NOT (dw = jaxa AND jaxa = hr AND hr = study) AS disagree FROM {_HARM}")
def p29_map_disagreement(spark, d):
    valid = (F.col("dw") > 0) & (F.col("jaxa") > 0) & (F.col("hr") > 0) & (F.col("study") > 0)
    same = (F.col("dw") == F.col("jaxa")) & (F.col("jaxa") == F.col("hr")) & (F.col("hr") == F.col("study"))
    return harmonised(spark, d).select("px_row", "px_col", "part", valid.alias("valid_all"), (valid & ~same).alias("disagree"))


_M, _S = (f"coalesce(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')" for c in ("maj", "sub"))
_PAIR = f"CASE {_M} || '/' || {_S} " + " ".join(f"WHEN '{a}/{b}' THEN {c}" for (a, b), c in PAIRS.items()) + " END"
_MAJ = f"CASE {_M} " + " ".join(f"WHEN '{a}' THEN {c}" for a, c in MAJOR.items()) + " END"
RECODED = f"(SELECT p_partkey, coalesce({_PAIR}, {_MAJ}) AS class_id, {_M} || '/' || CASE WHEN {_PAIR} IS NULL AND {_MAJ} IS NOT NULL THEN '(maj-default)' ELSE {_S} END AS reason, maj, sub FROM {{landuse}})"


@query(f"SELECT p_partkey, class_id, reason FROM {RECODED}")
def p30_f01_recoded_landuse(spark, d):
    return recoded(table(spark, d, "landuse")).select("p_partkey", "class_id", "reason")


@query(f"SELECT p_partkey, class_id FROM {RECODED} WHERE class_id IS NOT NULL")
def p31_mapped_only(spark, d):
    return recoded(table(spark, d, "landuse")).filter("class_id is not null").select("p_partkey", "class_id")


@query("""SELECT px_row, px_col, part, round(least(greatest((b8 - lo) / greatest(hi - lo, 1e-6), 0), 1), 6) AS stretched FROM (SELECT *, quantile_cont(b8, 0.02) OVER () AS lo, quantile_cont(b8, 0.98) OVER () AS hi
 FROM (SELECT px_row, px_col, part, nullif(b8, 65535)::DOUBLE AS b8 FROM {band_pixels})) WHERE b8 IS NOT NULL
 UNION ALL SELECT px_row, px_col, part, 0 FROM {band_pixels} WHERE b8 = 65535""")
def p32_contrast_stretch(spark, d):
    b = table(spark, d, "band_pixels").select("px_row", "px_col", "part", I.dn("b8").alias("b8"))
    return P.stretched(b, "b8").select("px_row", "px_col", "part", F.round("stretched", 6).alias("stretched"))


@query("SELECT scene, qa IS NULL OR qa >= 0.6 AS lenient, coalesce(qa >= 0.6, false) AS strict FROM {observations}")
def p33_p34_cloud_masks(spark, d):
    return table(spark, d, "observations").select("scene", P.clear_or_unknown(0.6).alias("lenient"), P.clear(0.6).alias("strict"))


@query("SELECT scene, pixel FROM {observations} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND cloud <= 20")
def p35_scene_filter(spark, d):
    return P.scenes_between(table(spark, d, "observations"), "2024-01-05", "2024-01-20", 20).select("scene", "pixel")


@query("SELECT px_row, px_col, z, CASE WHEN z IS NOT NULL THEN CAST(least(greatest(len(list_filter([-65, 0, 5, 10, 20, 30, 50, 100, 200, 350], lambda e: e <= z)), 1), 9) AS INT) END AS elevation FROM {dem}")
def p39_elevation_class(spark, d):
    return table(spark, d, "dem").select("px_row", "px_col", "z", P.elevation_class().alias("elevation"))


@query("SELECT sample_id, list_transform(range(1, 11), lambda k: round(ae[k]::DOUBLE + 0.5 * ln(k / 55.0), 6)) AS shifted FROM {ae_pixels}")
def p41_shifted_logits(spark, d):
    from math import log

    p = table(spark, d, "ae_pixels").withColumn("logits", F.slice("ae", 1, 10).cast("array<double>"))
    return p.select("sample_id", F.transform(P.shifted_logits("logits", [log(k / 55) for k in range(1, 11)], 0.5), lambda x: scaled_round(x)).alias("shifted"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(concat('#', c_name, ' / ', c_mktsegment, '!'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS stem FROM {customer}")
def f02_safe_stem(spark, d):
    c = table(spark, d, "customer").withColumn("t", F.concat(F.lit("#"), "c_name", F.lit(" / "), "c_mktsegment", F.lit("!")))
    return c.select("c_custkey", N.safe_stem("t").alias("stem"))


_FAM = "CASE replace(replace(lower({}), '-', ''), '_', '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.FAMILIES.items()) + " END"


@query(f"SELECT run_name, {_FAM.format('family')} AS family, CASE feature_set WHEN 'ae64' THEN 'AE64' ELSE 'AE64_plus10indices' END AS features FROM {{runs}}")
def f03_display_names(spark, d):
    return table(spark, d, "runs").select("run_name", N.family_name("family").alias("family"), N.feature_set_name("feature_set").alias("features"))


@query("""SELECT run_name, CASE family WHEN 'FT-Transformer' THEN 'fttransformer' WHEN 'ResMLP' THEN 'resmlp' WHEN 'xgb' THEN 'xgboost' ELSE family END AS family,
 CASE WHEN feature_set = 'ae64' THEN 'ae64' ELSE 'ae64_plus10indices' END AS features FROM {runs}""")
def f04_names_from_groups(spark, d):
    short = F.when(F.col("family") == "FT-Transformer", "ftt").otherwise(F.lower("family"))
    r = table(spark, d, "runs").withColumn("grp", F.concat(short, F.when(F.col("feature_set") == "ae64", F.lit("_ae64_grid")).otherwise(F.lit("_ae64_plus10idx_grid"))))
    return r.select("run_name", N.family_of_group("grp").alias("family"), N.feature_set_of_group("grp").alias("features"))


@query("SELECT run_name, run_name AS last FROM {runs}")
def f05_last_path_part(spark, d):
    return table(spark, d, "runs").withColumn("p", F.concat(F.lit("/data/runs/"), "run_name", F.lit("/"))).select("run_name", N.last_part("p").alias("last"))


@query("SELECT run_name, printf('final10seed_%s_%s_seed%03d', family, feature_set, seed) AS name FROM {runs}")
def f06_seeded_run_name(spark, d):
    return table(spark, d, "runs").select("run_name", N.seeded_name("family", "feature_set", "seed").alias("name"))


@query("SELECT l_orderkey, l_partkey, concat('B', CASE WHEN l_linenumber = 7 THEN '8A' ELSE CAST(l_linenumber AS VARCHAR) END) AS band FROM {lineitem}")
def f07_band_name(spark, d):
    raw = F.when(F.col("l_linenumber") == 7, "B8A").otherwise(F.format_string("B%02d", F.col("l_linenumber")))
    return table(spark, d, "lineitem").withColumn("raw", raw).select("l_orderkey", "l_partkey", N.band_name("raw").alias("band"))


_V = "((c_custkey * 7919 % 36000) / 100.0::DOUBLE - 180)"


@query(f"""SELECT c_custkey, printf('%d°%02d′', CAST(floor(abs(v)) + CASE WHEN mm = 60 THEN 1 ELSE 0 END AS INT), mm % 60) || CASE WHEN v >= 0 THEN 'E' ELSE 'W' END AS dm,
 printf('%d°%02d′%02d″', CAST(floor(abs(v)) + CASE WHEN m2 = 60 THEN 1 ELSE 0 END AS INT), m2 % 60, s % 60) || CASE WHEN v >= 0 THEN 'N' ELSE 'S' END AS dms FROM (
 SELECT *, CAST(floor(part) + CASE WHEN s = 60 THEN 1 ELSE 0 END AS INT) AS m2 FROM (SELECT *, CAST(round_even(abs(v) % 1 * 60, 0) AS INT) AS mm, abs(v) % 1 * 60 AS part, CAST(round_even(abs(v) % 1 * 60 % 1 * 60, 0) AS INT) AS s
 FROM (SELECT c_custkey, {_V} AS v FROM {{customer}})))""")
def f08_degree_minutes(spark, d):
    c = table(spark, d, "customer").withColumn("v", (F.col("c_custkey") * 7919 % 36000) / F.lit(100.0) - 180)
    return c.select("c_custkey", N.degree_minute("v", "lon").alias("dm"), N.degree_minute_second("v", "lat").alias("dms"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Western Zone' WHEN 1 THEN 'Central Zone' WHEN 2 THEN 'Eastern Zone' ELSE 'Outer Delta' END AS zone FROM {nation}")
def f09_zone_name(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("western", "central", "eastern", "outer delta"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "nation").withColumn("k", key).select("n_nationkey", N.zone_name("k").alias("zone"))


@query("SELECT sample_id, array_to_string([sample_id, area, class_id], '|') AS piped, array_to_string([sample_id, area, class_id], '-') AS dashed FROM {ae_pixels}")
def f10_joined_lists(spark, d):
    c = ["sample_id", "area", "class_id"]
    return table(spark, d, "ae_pixels").select("sample_id", N.joined_list(c, "|").alias("piped"), N.joined_list(c, "-").alias("dashed"))


@query("SELECT CASE WHEN pos <= 64 THEN 'embedding' ELSE 'index' END AS grp, count(*) AS n FROM {ae_pixels}, range(1, 75) t(pos) GROUP BY 1")
def f11_feature_group(spark, d):
    p = table(spark, d, "ae_pixels").withColumns({c: F.lit(k) for k, c in enumerate(_IDX)})
    places = P.fused(p, _IDX).select(F.posexplode("features").alias("pos", "v"))
    return places.groupBy(F.when(F.col("pos") < 64, "embedding").otherwise("index").alias("grp")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(props->>'$.k' AS INT) AS k, coalesce(props->>'$.missing', 'none') AS other FROM {events}")
def f12_f13_json_fields(spark, d):
    e = table(spark, d, "events").withColumn("j", F.from_json("props", "k int, missing string"))
    return e.select("event_id", F.col("j.k").alias("k"), F.coalesce("j.missing", F.lit("none")).alias("other"))


@query("""SELECT event_id, event_type AS "run.kind", user_id AS "run.by.user", CAST(props->>'$.k' AS INT) AS "run.by.k", concat('[', user_id, ',', event_id % 7, ']') AS "run.seeds", value AS score FROM {events}""")
def f12_flattened_records(spark, d):
    e = table(spark, d, "events")
    by = F.struct(F.col("user_id").alias("user"), F.from_json("props", "k int")["k"].alias("k"))
    run = F.struct(F.col("event_type").alias("kind"), by.alias("by"), F.array("user_id", F.col("event_id") % 7).alias("seeds"))
    records = e.select(F.to_json(F.struct("event_id", run.alias("run"), F.col("value").alias("score"))).alias("text"))
    kind = "event_id long, run struct<kind:string,by:struct<user:long,k:int>,seeds:array<long>>, score double"
    return flattened(records.select(F.from_json("text", kind).alias("r")).select("r.*"))


@query("SELECT px_row, px_col, part, round(coalesce(b4 / nullif(b8, 0), 0), 6) AS zero, round(b4 / nullif(b8, 0), 6) AS missing FROM (SELECT px_row, px_col, part, b4::DOUBLE AS b4, b8::DOUBLE AS b8 FROM {band_pixels})")
def f14_f15_safe_divide(spark, d):
    b = table(spark, d, "band_pixels")
    a, z = F.col("b4").cast("double"), F.col("b8").cast("double")
    return b.select("px_row", "px_col", "part", F.round(N.safe_divide(a, z), 6).alias("zero"), F.round(N.safe_divide(a, z, None), 6).alias("missing"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE 'inf'::DOUBLE END AS hi FROM {customer}")
def f16_number_or_infinity(spark, d):
    c = table(spark, d, "customer").withColumn("t", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal").cast("string")).when(F.col("c_custkey") % 3 == 1, F.lit("")).otherwise(F.lit("n/a")))
    return c.select("c_custkey", N.number_or_infinity("t").alias("hi"))


@query("SELECT scene, CASE WHEN ts >= TIMESTAMP '2023-10-01' AND ts < TIMESTAMP '2024-01-01' THEN 'season' WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-05-01' THEN 'backup' ELSE 'none' END AS season, CAST(abs(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-15') // 1000) AS BIGINT) AS off_ms FROM {observations}")
def f18_f19_seasons(spark, d):
    one, two = P.season(10, 1, 3, F.lit(2023)), P.season(1, 1, 4, F.lit(2024))
    season = F.when((F.col("ts") >= one[0]) & (F.col("ts") < one[1]), "season").when((F.col("ts") >= two[0]) & (F.col("ts") < two[1]), "backup").otherwise("none")
    off = F.abs(F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-15").cast("timestamp")))
    return table(spark, d, "observations").select("scene", season.alias("season"), off.alias("off_ms"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in N.CLASS_NAMES.items()) + " END AS name FROM {lineitem}")
def f20_j15_class_name(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", N.class_name("l_linenumber").alias("name"))
