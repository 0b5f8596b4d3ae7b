"""Queries of scans, sinks, models and incremental work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from landloom.operators import accuracy as A
from landloom.operators import models as M
from landloom.operators import runs as R
from landloom.operators import sampling as S
from landloom.queries import query
from landloom.queries.accuracy import rounded
from landloom.queries.samples import SPLIT, samples
from landloom.sources import tables as T
from landloom.sources.derived import table
from landloom.sources.shared import folder
from landloom.streaming import incremental


@query("SELECT c_custkey, c_name, c_acctbal FROM {customer}")
def s04_csv_round_trip(spark, d):
    at = folder(spark)
    T.write_table(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), at, "csv")
    return T.read_csv(spark, at, "c_custkey long, c_name string, c_acctbal double", ["c_custkey", "c_acctbal"])


@query("SELECT s_suppkey, s_acctbal FROM {supplier}")
def s05_run_summaries(spark, d):
    at, run = folder(spark), F.expr("s_suppkey div 50")
    summary = F.to_json(F.collect_list(F.struct("s_suppkey", "s_acctbal")), {"pretty": "true"})
    # one file of many lines per run, and a broken one
    table(spark, d, "supplier").groupBy(run.alias("run")).agg(summary.alias("value")).write.partitionBy("run").text(at)
    spark.createDataFrame([('[{"s_suppkey": 1, "s_acctbal":',)], "value string").coalesce(1).write.text(f"{at}/run=broken")
    found = T.read_summaries(spark, f"{at}/run=*")
    named = F.regexp_extract("path", "run=([^/]+)/", 1)
    return found.filter(named == run.cast("string")).select("s_suppkey", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("SELECT o_orderkey, o_totalprice FROM {orders}")
def s06_parquet_round_trip(spark, d):
    at = folder(spark)
    T.write_table(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), at)
    return T.read_table(spark, at, "o_orderkey long, o_totalprice double")


@query(f"SELECT split, count(*) AS n FROM {SPLIT} GROUP BY 1")
def s07_sample_archive(spark, d):
    at, s = folder(spark), samples(spark, d)
    T.write_samples(s.select("sample_id", "class_id", "ae", "split"), S.feature_statistics(s, "ae"), {"seed": "42"}, at)
    return spark.read.parquet(f"{at}/samples").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT px_row, px_col, class_id, year FROM {class_year} WHERE px_row BETWEEN 512 AND 1023")
def s08_raster_window(spark, d):
    at = folder(spark)
    T.write_raster(table(spark, d, "class_year"), at, 512)
    return spark.read.parquet(at).filter("tile_r = 1").select("px_row", "px_col", "class_id", F.col("year").cast("int").alias("year"))


@query("SELECT c1, count(*) AS n FROM {class_pair} WHERE c1 IS NOT NULL GROUP BY 1")
def s09_report(spark, d):
    at = folder(spark)
    T.write_report(table(spark, d, "class_pair").filter("c1 is not null").groupBy("c1").agg(F.count("*").alias("n")), at, ["c1", "n"])
    return T.read_csv(spark, at, "c1 int, n long")


@query()
def s10_inventory(spark, d):
    at = folder(spark)
    table(spark, d, "supplier").repartition(3).write.parquet(at)
    return T.inventory(spark, at).filter("type = 'parquet'").select("type", "parent", (F.col("size") > 0).alias("full"))


@query("SELECT 'in' AS role, true AS present UNION ALL SELECT 'out', false")
def s11_file_roles(spark, d):
    at = folder(spark)
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.parquet(f"{at}/classes")
    found = T.inventory(spark, at).groupBy(F.col("parent").alias("name"))
    files = found.agg(F.min("path").alias("path"), F.sum("size").alias("size"))
    return T.file_roles(spark, {"in": "classes", "out": "report"}, files).select("role", "present")


@query("SELECT run_name AS role, seed IN (SELECT seed FROM {runs} WHERE val_loss < 0.4) AS present FROM {runs}")
def s11_roles_of_runs(spark, d):
    at, runs = folder(spark), table(spark, d, "runs")
    runs.filter("val_loss < 0.4").select("run_name", "seed").write.partitionBy("seed").parquet(at)
    found = T.inventory(spark, at).groupBy(F.col("parent").alias("name")).agg(F.min("path").alias("path"), F.sum("size").alias("size"))
    return T.file_roles(spark, runs.select(F.col("run_name").alias("role"), F.concat(F.lit("seed="), "seed").alias("name")), found).select("role", "present")


@query("SELECT px_row, px_col, z FROM {dem}")
def r01_only_new_files(spark, d):
    at = folder(spark)
    dem = table(spark, d, "dem")
    dem.filter("px_row < 10").write.mode("append").parquet(f"{at}/in")
    run = lambda: incremental.process_new(spark, f"{at}/in", dem.schema, lambda t: t, f"{at}/out", f"{at}/done").awaitTermination()
    run()
    dem.filter("px_row >= 10").write.mode("append").parquet(f"{at}/in")
    run()
    return spark.read.schema(dem.schema).parquet(f"{at}/out")


@query("SELECT px_row, px_col, value FROM (SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY tile DESC) AS r FROM {tiles}) WHERE r = 1")
def r02_updated_mosaic(spark, d):
    at = folder(spark)
    tiles = table(spark, d, "tiles").select(F.col("px_row").cast("long").alias("px_row"), F.col("px_col").cast("long").alias("px_col"), "value", F.col("tile").alias("delivery"))
    for k in (0, 1, 2):
        tiles.filter(F.col("delivery") == k).write.mode("append").parquet(f"{at}/in")
        incremental.update_mosaic(spark, f"{at}/in", tiles.schema, f"{at}/out", f"{at}/done", 4).awaitTermination()
    return incremental.read_mosaic(spark, f"{at}/out", tiles.schema).select("px_row", "px_col", "value")


def _layers() -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(42)
    w, b = M.fold_batch_norm(rng.normal(size=(32, 64)), np.zeros(32), np.ones(32), np.zeros(32), np.zeros(32), np.ones(32))
    return [(w, b), (rng.normal(size=(10, 32)), np.zeros(10))]


@query()
def m01_scored_pixels(spark, d):
    p = M.scored(table(spark, d, "ae_pixels"), "ae", _layers())
    return p.select("sample_id", F.array_position("p", F.array_max("p")).alias("class_id"), F.round(F.array_max("p"), 6).alias("confidence"))


@query("SELECT 64::BIGINT AS n, 0.0::DOUBLE AS max_diff FROM {ae_pixels} LIMIT 1")
def m02_same_statistics(spark, d):
    at, s = folder(spark), samples(spark, d)
    T.write_samples(s.select("sample_id", "split"), S.feature_statistics(s, "ae"), {}, at)  # as training leaves them
    return M.require_same_statistics(S.feature_statistics(s, "ae"), spark.read.parquet(f"{at}/statistics"))


_MOMENTS = "SELECT k, avg(ae[k]::DOUBLE) AS mu, stddev_pop(ae[k]::DOUBLE) AS sigma FROM {}, range(1, 65) r(k) {} GROUP BY k"


@query(f"SELECT count(*) AS n, round(max(greatest(abs(p.mu - q.mu), abs(p.sigma - q.sigma))), 9) AS max_diff FROM ({_MOMENTS.format(SPLIT, '')}) p JOIN ({_MOMENTS.format(SPLIT, "WHERE split = 'train'")}) q USING (k)")
def m02_statistics_of_all_and_training_rows(spark, d):
    s = samples(spark, d)
    got = M.require_same_statistics(S.feature_statistics(s.withColumn("split", F.lit("train")), "ae"), S.feature_statistics(s, "ae"), 1.0)
    return rounded(got, "max_diff", digits=9)


def _evaluated(p, keys):
    return rounded(A.run_metrics(A.confusion(p.filter("split <> 'train'"), [*keys, "split"]), [*keys, "split"]), "accuracy", "macro_f1").select(*keys, "split", "n", "accuracy", "macro_f1")


@query()
def m03_linear_classifier(spark, d):
    return _evaluated(M.fit_and_predict(M.prepared(samples(spark, d), "ae").cache(), "linear", 64), [])


def _best_of_grid(spark, d, kind, settings, seeds):
    """Runs of a grid in order of their validation results, with those on test rows."""
    runs = _evaluated(M.grid(M.prepared(samples(spark, d), "ae").cache(), kind, 64, settings, seeds), ["run_name"])
    val = runs.filter("split = 'val'").select("run_name", F.col("macro_f1").alias("val_f1"), (1 - F.col("accuracy")).alias("val_loss"))
    return val.join(runs.filter("split = 'test'").select("run_name", F.col("macro_f1").alias("test_f1")), "run_name", "left").orderBy(*R.best_order())


@query()
def m03_perceptron(spark, d):
    return _best_of_grid(spark, d, "perceptron", {"hidden": [[16], [32]], "epochs": [6]}, [42])


@query()
def m04_boosted(spark, d):
    return _best_of_grid(spark, d, "boosted", {"depth": [2, 3], "rounds": [6]}, [42])


@query()
def m04_a47_forest_importance(spark, d):
    data = M.prepared(samples(spark, d), "ae").cache()
    model = M.estimator("forest", 64, 42).fit(data.filter("split = 'train'"))
    return M.feature_importance(model, [f"ae_{k:02d}" for k in range(1, 65)], spark)


@query()
def m05_m08_grid_of_runs(spark, d):
    return _best_of_grid(spark, d, "forest", {"maxDepth": [3, 4]}, [11, 12])
