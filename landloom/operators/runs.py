"""Tables of training runs: selection, ranks, summaries and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known(c: str) -> Column:
    """A number with NaN as null, so that it sorts as missing."""
    return F.when(~F.isnan(c), F.col(c))


def best_order() -> list[Column]:
    """Validation F1 and test F1 from the top, loss from the bottom, missing last, then the name."""
    return [known("val_f1").desc_nulls_last(), known("test_f1").desc_nulls_last(), known("val_loss").asc_nulls_last(), F.col("run_name").asc()]


def first_of(runs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first run of each group."""
    return runs.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def flagged(runs: DataFrame, metric: str) -> DataFrame:
    """Whether a run is the best of its family, and of all; the first name on ties."""
    order = [known(metric).desc_nulls_last(), F.col("run_name").asc()]
    top = runs.agg(F.max(known(metric)).alias("_m"))
    first = runs.join(F.broadcast(top), known(metric) == F.col("_m")).agg(F.min("run_name").alias("_best"))
    marked = runs.withColumn("best_of_family", F.row_number().over(Window.partitionBy("family").orderBy(*order)) == 1)
    return marked.join(F.broadcast(first), how="cross").withColumn("best_of_all", F.coalesce(F.col("run_name") == F.col("_best"), F.lit(False))).drop("_best")


def test_selected(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Best by test score per family and feature set among runs that have artifacts."""
    return first_of(runs.join(artifacts, "run_name", "left_semi"), ["family", "feature_set"], [known("test_f1").desc_nulls_last(), F.col("run_name").asc()])


def best_by_accuracy(confusion: DataFrame, by: list[str]) -> DataFrame:
    """Run of the highest accuracy per group, from long confusion matrices."""
    acc = confusion.groupBy(*by, "run_name").agg((F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return first_of(acc, by, [F.desc("accuracy"), F.asc("run_name")])


def dense_ranks(runs: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """Dense rank of a metric from the top within groups."""
    return runs.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(metric))))


def feature_set_gain(runs: DataFrame, metric: str, base: str, more: str) -> DataFrame:
    """Mean of a metric with the richer feature set less that with the base, per family."""
    p = runs.groupBy("family").pivot("feature_set", [base, more]).agg(F.avg(metric))
    return p.withColumn("delta", F.col(more) - F.col(base))


def in_order(rows: DataFrame, column: str, order: list[str]) -> list[Column]:
    """Sort keys for a given order of a column's values, others behind."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return [F.when(place == 0, len(order) + 1).otherwise(place), F.col(column)]


def seed_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Per family, runs, their seeds, and mean, sample deviation (0 for one), least and greatest of each metric."""
    aggs = [F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("seed")).cast("array<string>"), ",").alias("seeds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return runs.groupBy("family").agg(*aggs)


def explored_values(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Values of each parameter that a family and feature set has tried, joined by a bar."""
    long = F.array(*(F.struct(F.lit(c).alias("parameter"), F.col(c).cast("string").alias("value")) for c in columns))
    rows = runs.select("family", "feature_set", F.explode(long).alias("x")).select("family", "feature_set", "x.*").filter("value is not null")
    return rows.groupBy("family", "feature_set", "parameter").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("tried"))


def side_by_side(runs: DataFrame, sets: list[str]) -> DataFrame:
    """Best run of each feature set per family in one row, with the difference of their scores."""
    best = first_of(runs, ["family", "feature_set"], best_order())
    p = best.groupBy("family").pivot("feature_set", sets).agg(F.first("run_name").alias("run"), F.first("test_f1").alias("f1"))
    return p.withColumn("f1_diff", F.col(f"{sets[1]}_f1") - F.col(f"{sets[0]}_f1"))


def duplicates(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_combinations(runs: DataFrame, families: list[str], sets: list[str]) -> DataFrame:
    """Expected pairs of family and feature set that no run has."""
    f = F.explode(F.array(*map(F.lit, families))).alias("family")
    expected = runs.sparkSession.range(1).select(f).withColumn("feature_set", F.explode(F.array(*map(F.lit, sets))))
    return expected.join(runs, ["family", "feature_set"], "left_anti")


def combined(frames: list[DataFrame]) -> DataFrame:
    """Union of frames with unlike columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_columns(one: DataFrame, two: DataFrame) -> list[str]:
    """Columns that both have, in the order of the first."""
    return [c for c in one.columns if c in set(two.columns)]


def first_rows(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """At most ``n`` rows of a combined table, in order of their files and places."""
    return rows.orderBy(*order).limit(n)


def best_epoch(history: DataFrame, delta: float) -> DataFrame:
    """Epoch that training keeps per run.

    In order of epochs, one replaces the kept one if its score is higher by more
    than ``delta``, or within it with a lower loss.  A run has few epochs.
    """
    start = F.struct(F.lit(-1).cast("int").alias("epoch"), F.lit(float("-inf")).alias("f1"), F.lit(float("inf")).alias("loss"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("f1").cast("double").alias("f1"), F.col("loss").cast("double").alias("loss"))))

    def step(kept: Column, x: Column) -> Column:
        better = (x["f1"] > kept["f1"] + delta) | (F.abs(x["f1"] - kept["f1"]) <= delta) & (x["loss"] < kept["loss"])
        return F.when(better, x).otherwise(kept)

    return history.groupBy("run_name").agg(rows.alias("_h")).select("run_name", F.aggregate("_h", start, step).alias("b")).select("run_name", "b.epoch", "b.f1", "b.loss")


def history_of(history: DataFrame, name: str, own: DataFrame | None = None) -> DataFrame:
    """History rows of a run: its own table, or if that is absent or empty those of the master table.

    In the master table a run is found by the end of its folder's name.
    """
    rows = history.filter(F.col("run_dir").endswith(name))
    if own is None:
        return rows
    there = own.limit(1).select(F.lit(True).alias("_own"))  # one row at most
    return own.unionByName(rows.join(F.broadcast(there), F.col("_own"), "left_anti"), allowMissingColumns=True)


def class_union(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """Classes that occur in any of the columns of the tables."""
    parts = [t.select(F.col(c).alias("class_id")) for t in tables for c in columns if c in t.columns]
    return reduce(DataFrame.unionByName, parts).distinct()


def block_inventory(predictions: DataFrame) -> DataFrame:
    """Samples and blocks of each run's test split."""
    return predictions.filter("split = 'test'").groupBy("run_name").agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("n_blocks"))


def percent_within(rows: DataFrame, group: str, digits: int = 2) -> DataFrame:
    """Number of rows of each group and its share of all; null groups count as empty text."""
    n = rows.groupBy(F.coalesce(group, F.lit("")).alias(group)).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), digits))


def zone_ids(zones: DataFrame, name: str) -> DataFrame:
    """Ids from 1 of zone names, trimmed and in lower case, in alphabetical order."""
    z = zones.select(F.lower(F.trim(name)).alias("zone")).distinct()
    return z.withColumn("zone_id", F.dense_rank().over(Window.orderBy("zone")))


def only_runs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted runs."""
    return rows.join(wanted.select("run_name"), "run_name", "left_semi")
