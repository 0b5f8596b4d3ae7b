"""Queries of accuracy metrics and of the block bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions.counter import mixed_sql
from landloom.operators import accuracy as A
from landloom.operators import bootstrap as B
from landloom.operators import runs as R
from landloom.queries import query
from landloom.sources.derived import table

RUN = ["run_name"]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def per_class(source: str, keys: str, zero: str) -> str:
    """SQL of recall, precision and F1 of all ten classes."""
    z = (lambda x: f"coalesce({x}, 0)") if zero == "zero" else (lambda x: x)
    sums = f"SELECT {keys}, class_id, sum(t) AS support, sum(p) AS predicted, sum(h) AS hits FROM (SELECT {keys}, y_true AS class_id, n AS t, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS h FROM {source} UNION ALL SELECT {keys}, y_pred, 0, n, 0 FROM {source} UNION ALL SELECT DISTINCT {keys}, CAST(c AS INT), 0, 0, 0 FROM {source}, range(1, 11) r(c)) GROUP BY ALL"
    rp = f"SELECT *, {z('hits / nullif(support, 0)')} AS recall, {z('hits / nullif(predicted, 0)')} AS precision FROM ({sums})"
    return f"(SELECT *, {z('2 * precision * recall / nullif(precision + recall, 0)')} AS f1 FROM ({rp}))"


def per_run(source: str, keys: str, zero: str) -> str:
    m = ("recall", "precision", "f1")
    return f"(SELECT {keys}, CAST(sum(support) AS BIGINT) AS n, " + ", ".join(f"avg({c}) AS macro_{c}, sum({c} * support) / sum(support) AS weighted_{c}" for c in m) + f", sum(hits) / sum(support) AS accuracy FROM {per_class(source, keys, zero)} GROUP BY {keys})"


def matrix(spark, d):
    return table(spark, d, "confusion").filter("split = 'test'").drop("split", "feature_set", "model_family")


M = "(SELECT run_name, y_true, y_pred, n FROM {confusion} WHERE split = 'test')"


@query("SELECT run_name, y_true, y_pred, n FROM {confusion} WHERE split = 'test'")
def a19_confusion_matrix(spark, d):
    return A.confusion(table(spark, d, "predictions").filter("split = 'test'"), RUN)


@query("SELECT run_name, block_id, y_true, y_pred, n FROM {block_confusion}")
def a20_block_confusion(spark, d):
    return A.confusion(table(spark, d, "predictions").filter("split = 'test'"), ["run_name", "block_id"])


@query("SELECT run_name, y_true, " + ", ".join(f'CAST(coalesce(sum(n) FILTER (y_pred = {k}), 0) AS BIGINT) AS "{k}"' for k in range(1, 11)) + f" FROM {M} GROUP BY 1, 2")
def a21_wide_confusion(spark, d):
    return A.wide_confusion(matrix(spark, d), RUN)


@query(f"SELECT *, round(n / sum(n) OVER (PARTITION BY run_name, y_true), 6) AS fraction FROM {M}")
def a22_row_fractions(spark, d):
    return rounded(A.row_fractions(matrix(spark, d), RUN), "fraction")


_CLS = "run_name, class_id, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(hits AS BIGINT) AS hits, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1"


@query(f"SELECT {_CLS} FROM {per_class(M, 'run_name', 'zero')}")
def a23_class_metrics(spark, d):
    return rounded(A.class_metrics(matrix(spark, d), RUN), "recall", "precision", "f1")


_RUN = ", ".join(f"round({c}, 6) AS {c}" for c in ("macro_recall", "weighted_recall", "macro_precision", "weighted_precision", "macro_f1", "weighted_f1", "accuracy"))
_METRICS = ("macro_recall", "weighted_recall", "macro_precision", "weighted_precision", "macro_f1", "weighted_f1", "accuracy")


@query(f"SELECT run_name, n, {_RUN}, round(macro_recall, 6) AS balanced_accuracy FROM {per_run(M, 'run_name', 'zero')}")
def a24_a26_run_metrics(spark, d):
    return rounded(A.run_metrics(matrix(spark, d), RUN), *_METRICS, "balanced_accuracy")


BM = "(SELECT run_name, block_id, y_true, y_pred, n FROM {block_confusion})"


@query(f"SELECT run_name, block_id, n, {_RUN} FROM {per_run(BM, 'run_name, block_id', 'null')}")
def a25_metrics_skipping_undefined(spark, d):
    b = table(spark, d, "block_confusion").drop("feature_set", "model_family")
    return rounded(A.run_metrics(b, ["run_name", "block_id"], missing=None).drop("balanced_accuracy"), *_METRICS)


@query("SELECT run_name, round(avg(-ln(greatest(least(confidence, 1 - 1e-15), 1e-15))), 6) AS log_loss FROM (SELECT run_name, confidence::DOUBLE AS confidence FROM {scores}) GROUP BY 1")
def a27_log_loss(spark, d):
    s = table(spark, d, "scores").withColumn("confidence", F.col("confidence").cast("double"))
    return rounded(A.log_loss(s, RUN, "confidence"), "log_loss")


_P = f"(SELECT * FROM {per_class(M, 'run_name', 'zero')} WHERE support > 0 OR predicted > 0)"


@query(f"""SELECT run_name, CAST(class_id AS VARCHAR) AS "row", round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM {_P}
 UNION ALL SELECT run_name, 'Macro', round(avg(recall), 6), round(avg(precision), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM {_P} GROUP BY run_name
 UNION ALL SELECT run_name, 'Weighted', round(sum(recall * support) / sum(support), 6), round(sum(precision * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM {_P} GROUP BY run_name
 UNION ALL SELECT run_name, 'Overall', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM {_P} GROUP BY run_name""")
def a28_accuracy_table(spark, d):
    return rounded(A.present_metrics(matrix(spark, d), RUN), "recall", "precision", "f1")


@query(f"SELECT run_name, class_id, round(recall, 6) AS recall, round(precision, 6) AS precision FROM {per_class(M, 'run_name', 'zero')}")
def a53_floored_metrics(spark, d):
    return rounded(A.class_metrics(matrix(spark, d), RUN, floor=1e-12).select("run_name", "class_id", "recall", "precision"), "recall", "precision")


S = "(SELECT * REPLACE (confidence::DOUBLE AS confidence, uncertainty::DOUBLE AS uncertainty, margin::DOUBLE AS margin) FROM {scores})"


def scores(spark, d):
    return table(spark, d, "scores").withColumns({c: F.col(c).cast("double") for c in ("confidence", "uncertainty", "margin")})


@query(f"SELECT y_pred AS class_id, count(*) AS n, count(*) * 100.0::DOUBLE AS area_m2, round(avg(confidence), 6) AS mean_confidence, round(avg(uncertainty), 6) AS mean_uncertainty FROM {S} GROUP BY 1")
def a11_inference_summary(spark, d):
    return rounded(A.inference_summary(scores(spark, d)), "mean_confidence", "mean_uncertainty")


@query(f"SELECT CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM {S} GROUP BY 1")
def a12_confidence_histogram(spark, d):
    return rounded(A.confidence_histogram(scores(spark, d)), "fraction")


_BIN = "CAST(greatest(0, ceil({} * 10) - 1) AS INT)"


@query(f"SELECT run_name, split, {_BIN.format('confidence')} AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(CAST(y_true = y_pred AS INT)), 6) AS accuracy FROM {S} GROUP BY ALL")
def a13_reliability_bins(spark, d):
    return rounded(A.reliability(scores(spark, d), ["run_name", "split"]), "mean_confidence", "accuracy")


@query(f"SELECT run_name, split, {_BIN.format('uncertainty')} AS bin, count(*) AS n, round(avg(uncertainty), 6) AS mean_uncertainty, round(avg(CAST(y_true <> y_pred AS INT)), 6) AS error_rate, round(avg(CAST(y_true = y_pred AS INT)), 6) AS accuracy FROM {S} GROUP BY ALL")
def a14_uncertainty_error_bins(spark, d):
    return rounded(A.uncertainty_errors(scores(spark, d), ["run_name", "split"]), "mean_uncertainty", "error_rate", "accuracy")


@query(f"SELECT run_name, split, count(*) AS n, round(avg(CAST(y_true = y_pred AS INT)), 6) AS accuracy, round(avg(CAST(y_true <> y_pred AS INT)), 6) AS error_rate, round(avg(confidence), 6) AS mean_confidence, round(avg(uncertainty), 6) AS mean_uncertainty, round(avg(margin), 6) AS mean_margin FROM {S} GROUP BY ALL")
def a15_uncertainty_per_run(spark, d):
    return rounded(A.uncertainty_per_run(scores(spark, d), ["run_name", "split"]), "accuracy", "error_rate", "mean_confidence", "mean_uncertainty", "mean_margin")


@query("SELECT run_name, count(*) AS n, count(DISTINCT block_id) AS n_blocks FROM {predictions} WHERE split = 'test' GROUP BY 1")
def a48_block_inventory(spark, d):
    return R.block_inventory(table(spark, d, "predictions"))


@query("SELECT run_name, p.sample_id, y_true, y_pred, CAST(p.sample_id % 50 AS INT) AS block_id, count(*) AS n FROM {predictions} p GROUP BY ALL")
def j03_attached_blocks(spark, d):
    p = table(spark, d, "predictions")
    samples = p.select("sample_id", "block_id", "y_true").distinct()
    keyed = p.drop("block_id").withColumn("sample_id", F.struct("sample_id", "y_true"))
    got = A.attached_blocks(keyed, samples.withColumn("sample_id", F.struct("sample_id", "y_true")))
    return got.groupBy("run_name", F.col("sample_id.sample_id").alias("sample_id"), "y_true", "y_pred", "block_id").agg(F.count("*").alias("n"))


@query("SELECT run_name, 0::BIGINT AS max_diff, true AS equal FROM {block_confusion} GROUP BY run_name")
def v06_block_sums_match(spark, d):
    by_block = table(spark, d, "block_confusion").groupBy("run_name", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    return A.equal_matrices(by_block, matrix(spark, d), RUN)


@query(f"""SELECT run_name, CAST(max(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) AS BIGINT) AS max_diff, max(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) = 0 AS equal
 FROM (SELECT run_name, y_true, y_pred, sum(n) AS n FROM {{block_confusion}} WHERE run_name IN ('run_1', 'run_3', 'run_5') AND block_id <> (SELECT min(block_id) FROM {{block_confusion}}) OR run_name NOT IN ('run_1', 'run_3', 'run_5') GROUP BY ALL) a FULL JOIN {M} b USING (run_name, y_true, y_pred) GROUP BY run_name""")
def v06_block_sums_of_lost_blocks(spark, d):
    blocks = table(spark, d, "block_confusion")
    lost = blocks.agg(F.min("block_id").alias("block_id")).withColumn("_runs", F.array(*map(F.lit, ("run_1", "run_3", "run_5"))))  # one row
    left = blocks.join(F.broadcast(lost), (blocks["block_id"] == lost["block_id"]) & F.array_contains("_runs", F.col("run_name")), "left_anti")
    return A.equal_matrices(left.groupBy("run_name", "y_true", "y_pred").agg(F.sum("n").alias("n")), matrix(spark, d), RUN)


@query("SELECT run_name, count(DISTINCT block_id) AS n_blocks, (SELECT count(DISTINCT block_id) FROM {block_confusion}) - count(DISTINCT block_id) AS n_missing, (SELECT count(DISTINCT block_id) FROM {block_confusion}) = count(DISTINCT block_id) AS same FROM {block_confusion} GROUP BY run_name")
def u04_v07_same_blocks(spark, d):
    return A.same_blocks(table(spark, d, "block_confusion"))


@query("""WITH p AS (SELECT feature_set, run_name, block_id, y_true, sum(n) AS n FROM {block_confusion} GROUP BY ALL), q AS (SELECT feature_set, block_id, y_true, min(n) = max(n) AS eq, count(*) AS k FROM p GROUP BY ALL)
 SELECT q.feature_set, bool_and(eq AND k = r.runs) AS same FROM q JOIN (SELECT feature_set, count(DISTINCT run_name) AS runs FROM p GROUP BY 1) r ON q.feature_set = r.feature_set GROUP BY q.feature_set""")
def v07_same_block_labels(spark, d):
    return A.same_labels(table(spark, d, "block_confusion").drop("model_family"), ["feature_set"])


@query(f"SELECT run_name, n, {_RUN}, round(macro_recall, 6) AS balanced_accuracy, round(log_loss, 6) AS log_loss FROM {per_run(M, 'run_name', 'zero')} JOIN (SELECT run_name, avg(-ln(greatest(least(confidence, 1 - 1e-15), 1e-15))) AS log_loss FROM {S} WHERE split = 'test' GROUP BY 1) USING (run_name)")
def m06_evaluation(spark, d):
    m = A.run_metrics(A.confusion(table(spark, d, "predictions").filter("split = 'test'"), RUN), RUN)
    return rounded(m.join(A.log_loss(scores(spark, d).filter("split = 'test'"), RUN, "confidence"), "run_name"), *_METRICS, "balanced_accuracy", "log_loss")


@query("SELECT sample_id, CAST(k AS INT) AS class_id, round((ae[k]::DOUBLE + ae[k + 10]::DOUBLE) / 2, 6) AS p FROM {ae_pixels}, range(1, 11) r(k)")
def m09_averaged_probabilities(spark, d):
    p = table(spark, d, "ae_pixels")
    parts = [p.select("sample_id", F.slice("ae", a, 10).cast("array<double>").alias("p")) for a in (1, 11)]
    return rounded(A.averaged(parts[0].unionByName(parts[1]), ["sample_id"]), "p")


# Draws of any other kind, for the join of draws and blocks: a table derived from lineitem.
DRAWN = "(SELECT l_orderkey % 40 AS replicate, l_linenumber AS slot, l_partkey % 50 AS position FROM {lineitem})"
PLACES = "(SELECT block_id, row_number() OVER (ORDER BY block_id) - 1 AS position FROM (SELECT DISTINCT block_id FROM {block_confusion}))"
REPS = f"(SELECT run_name, feature_set, model_family, replicate, y_true, y_pred, sum(w * n) AS n FROM {{block_confusion}} JOIN {PLACES} p USING (block_id) JOIN (SELECT replicate, position, count(*) AS w FROM {DRAWN} GROUP BY ALL) USING (position) GROUP BY ALL)"
# Five thousand replicates, drawn by counter: matrices as the product of weights and blocks.
REPLICATES = 5000
SHARED = f"(SELECT replicate, slot, ({mixed_sql(42, 'replicate', 'slot')} * n) >> 32 AS position FROM (SELECT n, unnest(range({REPLICATES})) AS replicate FROM (SELECT count(DISTINCT block_id) AS n FROM {{block_confusion}})), LATERAL (SELECT unnest(range(n)) AS slot))"
MANY = f"(SELECT run_name, feature_set, model_family, replicate, y_true, y_pred, sum(w * n) AS n FROM {{block_confusion}} JOIN {PLACES} p USING (block_id) JOIN (SELECT replicate, position, count(*) AS w FROM {SHARED} GROUP BY ALL) USING (position) GROUP BY ALL)"
DIST = "(SELECT run_name, feature_set, model_family, replicate, unnest(['accuracy', 'macro_f1', 'weighted_f1']) AS metric, unnest([accuracy * 100, macro_f1 * 100, weighted_f1 * 100]) AS value FROM " + per_run(MANY, "run_name, feature_set, model_family, replicate", "null") + ")"
ROUND5 = "round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper, count(value) AS n_valid, count(*) - count(value) AS n_invalid"
KEYS = ["run_name", "feature_set", "model_family"]


def drawn(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("replicate"), F.col("l_linenumber").alias("slot"), (F.col("l_partkey") % 50).alias("position"))


def replicates(spark, d):
    b = table(spark, d, "block_confusion")
    return B.replicate_matrices(b, B.block_positions(b), drawn(spark, d), KEYS)


def many(spark, d):
    b = table(spark, d, "block_confusion")
    places = B.block_positions(b)
    return B.block_products(b.join(places, "block_id"), places.count(), REPLICATES, 42, KEYS)


def distribution(spark, d):
    return B.metric_distribution(many(spark, d), KEYS)


@query(f"SELECT * FROM {PLACES}")
def w10_block_positions(spark, d):
    return B.block_positions(table(spark, d, "block_confusion"))


@query(f"SELECT * FROM {SHARED}")
def b01_shared_draws(spark, d):
    n = table(spark, d, "block_confusion").select("block_id").distinct().count()
    return B.draws(spark, n, REPLICATES, 42)


@query(f"SELECT replicate, position, count(*) AS w FROM {DRAWN} GROUP BY ALL")
def b02_draw_weights(spark, d):
    return B.weights(drawn(spark, d))


@query(f"SELECT run_name, feature_set, model_family, replicate, y_true, y_pred, CAST(n AS BIGINT) AS n FROM {REPS}")
def b03_replicate_matrices(spark, d):
    return replicates(spark, d)


@query(f"SELECT run_name, y_true, y_pred, count(*) AS replicates, CAST(sum(n) AS BIGINT) AS total, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, CAST(sum(n * n) AS BIGINT) AS squares, CAST(sum(n * (replicate % 97)) AS BIGINT) AS order_check FROM {MANY} GROUP BY run_name, y_true, y_pred")
def b03_block_products(spark, d):
    n = F.col("n")
    sums = [F.count("*").alias("replicates"), F.sum(n).alias("total"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n * n).alias("squares"), F.sum(n * (F.col("replicate") % 97)).alias("order_check")]
    return many(spark, d).groupBy("run_name", "y_true", "y_pred").agg(*sums)


@query(f"SELECT run_name, feature_set, model_family, replicate, metric, round(value, 6) AS value FROM {DIST}")
def b04_metric_distribution(spark, d):
    return rounded(distribution(spark, d), "value")


@query(f"SELECT run_name, metric, {ROUND5} FROM {DIST} GROUP BY ALL")
def b05_b06_model_intervals(spark, d):
    return rounded(B.interval(distribution(spark, d), ["run_name", "metric"]), "mean", "lower", "upper")


_FS = f"(SELECT b.replicate, b.metric, b.value - a.value AS value FROM (SELECT replicate, metric, avg(value) AS value FROM {DIST} WHERE feature_set = 'AE64' GROUP BY ALL) a JOIN (SELECT replicate, metric, avg(value) AS value FROM {DIST} WHERE feature_set <> 'AE64' GROUP BY ALL) b ON a.replicate = b.replicate AND a.metric = b.metric)"


@query(f"SELECT metric, {ROUND5} FROM {_FS} GROUP BY metric")
def b07_j08_feature_set_difference(spark, d):
    v = distribution(spark, d).groupBy("feature_set", "replicate", "metric").agg(F.avg("value").alias("value"))
    diff = B.paired_difference(v, ["replicate", "metric"], "feature_set", "AE64", "AE64_plus10indices")
    return rounded(B.interval(diff, ["metric"]), "mean", "lower", "upper")


@query(f"SELECT o.run_name, o.metric, round(avg(b.value - o.value), 6) AS mean FROM {DIST} o JOIN {DIST} b ON o.replicate = b.replicate AND o.metric = b.metric WHERE b.run_name = 'run_3' AND o.run_name <> 'run_3' GROUP BY ALL")
def j09_model_gaps(spark, d):
    v = distribution(spark, d)
    gaps = B.model_gaps(v, v.filter("run_name = 'run_3'").select("run_name").distinct())
    return rounded(gaps.groupBy("run_name", "metric").agg(F.avg("value").alias("mean")), "mean")


_CD = f"(SELECT run_name, class_id, unnest(['recall', 'precision', 'f1']) AS metric, unnest([recall * 100, precision * 100, f1 * 100]) AS value FROM {per_class(MANY, 'run_name, feature_set, model_family, replicate', 'null')})"


@query(f"SELECT run_name, class_id, metric, {ROUND5}, count(value) < 4750 AS unstable FROM {_CD} GROUP BY run_name, class_id, metric")
def b08_class_intervals(spark, d):
    return rounded(B.class_intervals(many(spark, d).drop("feature_set", "model_family"), RUN, 4750), "mean", "lower", "upper")


@query(f"SELECT metric, {ROUND5} FROM (SELECT metric, replicate, avg(value) AS value FROM {DIST} GROUP BY ALL) GROUP BY metric")
def b09_consolidated_results(spark, d):
    per = distribution(spark, d).groupBy("metric", "replicate").agg(F.avg("value").alias("value"))
    return rounded(B.interval(per, ["metric"]), "mean", "lower", "upper")


_MACRO = "(SELECT replicate, unnest(['macro_recall', 'macro_precision']) AS metric, unnest([macro_recall * 100, macro_precision * 100]) AS value FROM " + per_run(MANY, "run_name, feature_set, model_family, replicate", "null") + ")"


@query(f"SELECT metric, {ROUND5} FROM (SELECT metric, replicate, avg(value) AS value FROM {_MACRO} GROUP BY ALL) GROUP BY metric")
def b09_macro_recall_precision(spark, d):
    each = B.metric_distribution(many(spark, d), KEYS, ("macro_recall", "macro_precision"))
    per = each.groupBy("metric", "replicate").agg(F.avg("value").alias("value"))
    return rounded(B.interval(per, ["metric"]), "mean", "lower", "upper")


@query(f"SELECT run_name, round(accuracy - lower, 5) AS err_low, round(upper - accuracy, 5) AS err_high, round(upper - lower, 5) AS width FROM (SELECT run_name, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM {DIST} WHERE metric = 'accuracy' GROUP BY 1) JOIN (SELECT run_name, accuracy * 100 AS accuracy FROM {per_run(M, 'run_name', 'zero')}) USING (run_name)")
def p37_error_bars(spark, d):
    i = B.interval(distribution(spark, d).filter("metric = 'accuracy'"), RUN)
    o = A.run_metrics(matrix(spark, d), RUN).select("run_name", (F.col("accuracy") * 100).alias("observed"))
    return rounded(B.error_bars(i.join(o, "run_name")).select("run_name", "err_low", "err_high", "width"), "err_low", "err_high", "width", digits=5)


@query()
def b10_multinomial_bootstrap(spark, d):
    reps = B.multinomial_matrices(matrix(spark, d), RUN, 1000, 42)
    return B.interval(B.metric_distribution(reps, RUN), ["run_name", "metric"])


@query()
def b11_multinomial_class_bootstrap(spark, d):
    reps = B.multinomial_matrices(matrix(spark, d).filter("run_name = 'run_3'"), RUN, 1000, 42)
    return B.class_intervals(reps, RUN, 950)


@query()
def b12_multinomial_areas(spark, d):
    from landloom.operators import change as C

    return B.multinomial_areas(C.class_areas(table(spark, d, "class_pair")).select("scope", "year", "class_id", "n"), ["scope", "year"], 1000, 42, 0.0001)


@query("SELECT DISTINCT class_id FROM (SELECT y_true AS class_id FROM {confusion} UNION SELECT y_pred FROM {confusion})")
def u03_class_union(spark, d):
    return R.class_union([table(spark, d, "confusion")], ["y_true", "y_pred"])
