"""Queries of run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.functions import names as N
from landloom.operators import runs as R
from landloom.queries import query
from landloom.queries.accuracy import rounded
from landloom.sources.derived import table

SETS = ["ae64", "ae64_plus10indices"]
BEST = "val_f1 DESC NULLS LAST, test_f1 DESC NULLS LAST, val_loss ASC NULLS LAST, run_name"
KNOWN = "(SELECT run_name, run_id, family, feature_set, seed, depth, s_nationkey, val_f1::DOUBLE AS val_f1, test_f1::DOUBLE AS test_f1, val_loss::DOUBLE AS val_loss FROM {runs})"


def runs(spark, d):
    r = table(spark, d, "runs").withColumns({c: F.col(c).cast("double") for c in ("val_f1", "test_f1", "val_loss")})
    return r.withColumn("val_loss", F.coalesce("val_loss", F.lit(float("nan"))))  # blanks come as NaN


@query(f"SELECT family, run_name FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {BEST}) AS r FROM {KNOWN}) WHERE r = 1")
def w04_best_run(spark, d):
    return R.first_of(runs(spark, d), ["family"], R.best_order()).select("family", "run_name")


@query(f"SELECT family, run_name FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY test_f1 DESC, run_name) AS r FROM {KNOWN}) WHERE r = 1")
def w05_first_by_metric(spark, d):
    return R.first_of(runs(spark, d), ["family"], [F.desc("test_f1"), F.asc("run_name")]).select("family", "run_name")


@query(f"SELECT run_name, row_number() OVER (PARTITION BY family ORDER BY val_f1 DESC NULLS LAST, run_name) = 1 AS best_of_family, run_name = (SELECT run_name FROM {KNOWN} ORDER BY val_f1 DESC NULLS LAST, run_name LIMIT 1) AS best_of_all FROM {KNOWN}")
def w06_best_flags(spark, d):
    return R.flagged(runs(spark, d), "val_f1").select("run_name", "best_of_family", "best_of_all")


@query(f"SELECT family, feature_set, run_name FROM (SELECT *, row_number() OVER (PARTITION BY family, feature_set ORDER BY test_f1 DESC NULLS LAST, run_name) AS r FROM {KNOWN} WHERE run_id % 4 <> 1) WHERE r = 1")
def w07_test_selected(spark, d):
    r = runs(spark, d)
    return R.test_selected(r, r.filter("run_id % 4 <> 1").select("run_name")).select("family", "feature_set", "run_name")


@query("SELECT feature_set, run_name, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY accuracy DESC, run_name) AS r FROM (SELECT feature_set, run_name, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n) AS accuracy FROM {confusion} GROUP BY 1, 2)) WHERE r = 1")
def w08_best_by_accuracy(spark, d):
    return rounded(R.best_by_accuracy(table(spark, d, "confusion"), ["feature_set"]), "accuracy")


@query(f"SELECT run_name, dense_rank() OVER (PARTITION BY feature_set ORDER BY test_f1 DESC) AS rank FROM {KNOWN}")
def w01_rank_in_feature_set(spark, d):
    return R.dense_ranks(runs(spark, d), "test_f1", ["feature_set"]).select("run_name", "rank")


@query(f"SELECT family, dense_rank() OVER (ORDER BY m DESC) AS rank FROM (SELECT family, max(test_f1) AS m FROM {KNOWN} GROUP BY 1)")
def w02_rank_families(spark, d):
    best = runs(spark, d).groupBy("family").agg(F.max("test_f1").alias("m"))
    return R.dense_ranks(best, "m", []).select("family", "rank")


@query(f"SELECT maj, n, round(n * 100.0 / sum(n) OVER (), 2) AS pct FROM (SELECT coalesce(maj, '') AS maj, count(*) AS n FROM {{landuse}} GROUP BY 1)")
def w03_percent_within(spark, d):
    return R.percent_within(table(spark, d, "landuse"), "maj")


@query(f"SELECT family, round(avg(test_f1) FILTER (feature_set = 'ae64_plus10indices') - avg(test_f1) FILTER (feature_set = 'ae64'), 6) AS delta FROM {KNOWN} GROUP BY 1")
def w09_feature_set_gain(spark, d):
    return rounded(R.feature_set_gain(runs(spark, d), "test_f1", *SETS).select("family", "delta"), "delta")


@query("SELECT CAST(row_number() OVER (ORDER BY lower(trim(n_name))) AS INT) AS zone_id, lower(trim(n_name)) AS zone FROM {nation}")
def w11_zone_ids(spark, d):
    return R.zone_ids(table(spark, d, "nation"), "n_name")


@query(f"SELECT run_name, row_number() OVER (ORDER BY {BEST}) AS place FROM {KNOWN}")
def t01_sorted_runs(spark, d):
    from pyspark.sql import Window

    return runs(spark, d).select("run_name", F.row_number().over(Window.orderBy(*R.best_order())).alias("place"))


@query(f"""SELECT run_name, row_number() OVER (ORDER BY list_position({N.FAMILY_ORDER}, fam), feature_set, run_name) AS place FROM (SELECT *, CASE replace(replace(lower(family), '-', ''), '_', '')
 {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.FAMILIES.items())} END AS fam FROM {KNOWN})""")
def t02_custom_order(spark, d):
    from pyspark.sql import Window

    r = runs(spark, d).withColumn("family", N.family_name("family"))
    return r.select("run_name", F.row_number().over(Window.orderBy(*R.in_order(r, "family", N.FAMILY_ORDER), "feature_set", "run_name")).alias("place"))


@query(f"""SELECT family, count(*) AS n, array_to_string(list_sort(list(DISTINCT seed)), ',') AS seeds, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in ("val_f1", "test_f1"))} FROM {KNOWN} GROUP BY 1""")
def a45_seed_summary(spark, d):
    return rounded(R.seed_summary(runs(spark, d), ["val_f1", "test_f1"]), *(f"{m}_{k}" for m in ("val_f1", "test_f1") for k in ("mean", "std")))


@query(f"SELECT family, feature_set, p AS parameter, array_to_string(list_sort(list(DISTINCT v)), '|') AS tried FROM (SELECT family, feature_set, unnest(['depth', 'seed']) AS p, unnest([CAST(depth AS VARCHAR), CAST(seed AS VARCHAR)]) AS v FROM {KNOWN}) GROUP BY ALL")
def a46_explored_values(spark, d):
    return R.explored_values(runs(spark, d), ["depth", "seed"])


_B = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, feature_set ORDER BY {BEST}) AS r FROM {KNOWN}) WHERE r = 1)"


@query(f"SELECT f.family, a.run_name AS base_run, b.run_name AS more_run, round(b.test_f1 - a.test_f1, 6) AS f1_diff FROM (SELECT DISTINCT family FROM {KNOWN}) f LEFT JOIN {_B} a ON a.family = f.family AND a.feature_set = 'ae64' LEFT JOIN {_B} b ON b.family = f.family AND b.feature_set = 'ae64_plus10indices'")
def j16_side_by_side(spark, d):
    s = R.side_by_side(runs(spark, d), SETS)
    return s.select("family", F.col("ae64_run").alias("base_run"), F.col("ae64_plus10indices_run").alias("more_run"), F.round("f1_diff", 6).alias("f1_diff"))


@query(f"SELECT family, feature_set, count(*) AS n FROM {KNOWN} GROUP BY 1, 2 HAVING count(*) > 1")
def v08_duplicate_runs(spark, d):
    return R.duplicates(runs(spark, d), ["family", "feature_set"])


@query(f"SELECT f.family, s.feature_set FROM (SELECT unnest(['mlp', 'lgbm', 'transformer', 'xgb']) AS family) f, (SELECT unnest({SETS}) AS feature_set) s WHERE NOT EXISTS (SELECT 1 FROM {KNOWN} r WHERE r.family = f.family AND r.feature_set = s.feature_set)")
def u02_missing_combinations(spark, d):
    return R.missing_combinations(runs(spark, d), ["mlp", "lgbm", "transformer", "xgb"], SETS)


@query(f"SELECT run_name, family, NULL::INT AS depth, test_f1 FROM {KNOWN} WHERE run_id % 2 = 0 UNION ALL SELECT run_name, NULL, depth, test_f1 FROM {KNOWN} WHERE run_id % 2 = 1")
def u01_union_of_unlike(spark, d):
    r = runs(spark, d)
    return R.combined([r.filter("run_id % 2 = 0").select("run_name", "family", "test_f1"), r.filter("run_id % 2 = 1").select("run_name", "depth", "test_f1")])


@query("SELECT run_name, sample_id, y_true FROM (SELECT *, row_number() OVER (ORDER BY run_name, sample_id, y_true, y_pred, w1, w2) AS r FROM {predictions}) WHERE r <= 5000")
def s13_capped_rows(spark, d):
    return R.first_rows(table(spark, d, "predictions"), 5000, ["run_name", "sample_id", "y_true", "y_pred", "w1", "w2"]).select("run_name", "sample_id", "y_true")


@query("SELECT run_name, count(*) AS n FROM {predictions} WHERE run_name IN (SELECT run_name FROM {runs} WHERE depth = 1) GROUP BY 1")
def j12_runs_subset(spark, d):
    wanted = table(spark, d, "runs").filter("depth = 1").select("run_name")
    return R.only_runs(table(spark, d, "predictions"), wanted).groupBy("run_name").agg(F.count("*").alias("n"))


_H = "(SELECT s_nationkey AS run_name, s_suppkey AS epoch, round((s_suppkey * 37 % 101) / 101.0, 3)::DOUBLE AS f1, round((s_suppkey * 53 % 97) / 97.0, 3)::DOUBLE AS loss FROM {supplier})"


@query(f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY epoch) AS k FROM {_H}), f AS (
 SELECT run_name, k, epoch, f1, loss FROM h WHERE k = 1 UNION ALL
 SELECT h.run_name, h.k, CASE WHEN b THEN h.epoch ELSE f.epoch END, CASE WHEN b THEN h.f1 ELSE f.f1 END, CASE WHEN b THEN h.loss ELSE f.loss END
 FROM f JOIN h ON h.run_name = f.run_name AND h.k = f.k + 1, LATERAL (SELECT h.f1 > f.f1 + 0.05::DOUBLE OR (abs(h.f1 - f.f1) <= 0.05::DOUBLE AND h.loss < f.loss) AS b) l)
 SELECT run_name, CAST(epoch AS INT) AS epoch, f1, loss FROM (SELECT *, max(k) OVER (PARTITION BY run_name) AS m FROM f) WHERE k = m""")
def m07_best_epoch(spark, d):
    h = table(spark, d, "supplier").select(F.col("s_nationkey").alias("run_name"), F.col("s_suppkey").alias("epoch"), F.expr("cast(round((s_suppkey * 37 % 101) / 101.0, 3) as double)").alias("f1"), F.expr("cast(round((s_suppkey * 53 % 97) / 97.0, 3) as double)").alias("loss"))
    return R.best_epoch(h, 0.05)


@query(f"SELECT run_name, seed FROM {KNOWN} WHERE run_name LIKE '%\\_7' ESCAPE '\\'")
def s12_run_history(spark, d):
    h = runs(spark, d).withColumn("run_dir", F.concat(F.lit("/runs/grid/"), "run_name"))
    return R.history_of(h, "run_7").select("run_name", "seed")


@query("SELECT count(*) AS n FROM {ae_pixels}")
def u05_common_columns(spark, d):
    a, b = table(spark, d, "ae_pixels"), table(spark, d, "dem")
    keys = R.common_columns(a, b)
    return a.join(b, keys).agg(F.count("*").alias("n"))
