"""Accuracy of classifications from predictions and confusion matrices.

A long confusion matrix has y_true, y_pred (1 to 10) and n, with the key columns
that tell the matrices apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions.names import safe_divide

CLASSES = 10


def confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels per pair of classes; labels outside the ten are ignored.  Stored sparse."""
    return predictions.filter(F.col("y_true").between(1, CLASSES) & F.col("y_pred").between(1, CLASSES)).groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def wide_confusion(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """One row per true class, a column per predicted class."""
    return matrix.groupBy(*keys, "y_true").pivot("y_pred", list(range(1, CLASSES + 1))).sum("n").na.fill(0)


def row_fractions(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each cell in its true class."""
    return matrix.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "y_true")))


def class_counts(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, true and predicted pixels of all ten classes per matrix, zeros included: one shuffle."""
    cell = F.array(F.struct(F.col("y_true").alias("class_id"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("y_pred").alias("class_id"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))
    sums = matrix.select(*keys, F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit"), F.explode(cell).alias("c"))
    sums = sums.groupBy(*keys, "c.class_id").agg(F.sum("c.t").alias("support"), F.sum("c.p").alias("predicted"), F.sum(F.when(F.col("c.t") > 0, F.col("hit")).otherwise(0)).alias("hits"))
    all_classes = sums.select(*keys).distinct().withColumn("class_id", F.explode(F.sequence(F.lit(1), F.lit(CLASSES))))
    return all_classes.join(sums, [*keys, "class_id"], "left").na.fill(0, ["support", "predicted", "hits"])


def class_metrics(matrix: DataFrame, keys: list[str], missing: float | None = 0.0, floor: float | None = None) -> DataFrame:
    """A23 with ``missing`` 0, A25 with None, A53 with ``floor``: recall, precision, F1 and support per class.

    ``missing`` is the value of an undefined quotient; ``floor`` keeps
    denominators above a small number instead.
    """

    def ratio(a: Column, b: Column) -> Column:
        return a / F.greatest(b.cast("double"), F.lit(floor)) if floor else safe_divide(a, b, missing)

    c = class_counts(matrix, keys).withColumns({"recall": ratio(F.col("hits"), F.col("support")), "precision": ratio(F.col("hits"), F.col("predicted"))})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def run_metrics(matrix: DataFrame, keys: list[str], missing: float | None = 0.0, floor: float | None = None) -> DataFrame:
    """A24 (0), A25 (None), A26 (balanced): overall, macro and support-weighted metrics per matrix."""
    c = class_metrics(matrix, keys, missing, floor)
    total = F.sum("support")
    out = [F.sum("hits").alias("_h"), total.alias("n"), *(F.avg(m).alias(f"macro_{m}") for m in ("recall", "precision", "f1")), *(F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in ("recall", "precision", "f1"))]
    got = c.groupBy(*keys).agg(*out).withColumn("accuracy", safe_divide(F.col("_h"), F.col("n"), missing)).withColumn("balanced_accuracy", F.col("macro_recall"))
    return got.drop("_h")


def present_metrics(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """A row per class that occurs, and rows Overall, Macro and Weighted."""
    rows = class_metrics(matrix, keys).filter("support > 0 or predicted > 0")
    per_class = rows.select(*keys, F.col("class_id").cast("string").alias("row"), "recall", "precision", "f1", "support")
    m = ("recall", "precision", "f1")
    macro = rows.groupBy(*keys).agg(F.lit("Macro").alias("row"), *(F.avg(c).alias(c) for c in m), F.sum("support").alias("support"))
    weighted = rows.groupBy(*keys).agg(F.lit("Weighted").alias("row"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in m), F.sum("support").alias("support"))
    overall = rows.groupBy(*keys).agg(F.lit("Overall").alias("row"), *((F.sum("hits") / F.sum("support")).alias(c) for c in m), F.sum("support").alias("support"))
    return per_class.unionByName(overall).unionByName(macro).unionByName(weighted)


def log_loss(predictions: DataFrame, keys: list[str], p: str, eps: float = 1e-15) -> DataFrame:
    """Mean negative logarithm of the probability ``p`` of the true class, clipped."""
    return predictions.groupBy(*keys).agg(F.avg(-F.log(F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps)))).alias("log_loss"))


def confidence_histogram(pixels: DataFrame, conf: str = "confidence") -> DataFrame:
    """Ten bins closed on the left, 1.0 in the last, with the share of all."""
    b = pixels.filter(F.col(conf).isNotNull()).groupBy(F.least(F.floor(F.col(conf) * 10.0), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return b.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def right_closed_bin(value: Column) -> Column:
    """Bin 0..9 of a value, closed on the right, 0 in the first."""
    return F.greatest(F.lit(0), F.ceil(value * 10.0) - 1).cast("int")


def reliability(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per bin of confidence, number, mean confidence and accuracy."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    return scores.groupBy(*keys, right_closed_bin(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(hit).alias("accuracy"))


def uncertainty_errors(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per bin of uncertainty, number, mean uncertainty, error rate and accuracy."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    return scores.groupBy(*keys, right_closed_bin(F.col("uncertainty")).alias("bin")).agg(F.count("*").alias("n"), F.avg("uncertainty").alias("mean_uncertainty"), F.avg(1 - hit).alias("error_rate"), F.avg(hit).alias("accuracy"))


def uncertainty_per_run(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per run, number, accuracy, error rate and mean confidence, uncertainty and margin."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(1 - hit).alias("error_rate"), *(F.avg(c).alias(f"mean_{c}") for c in ("confidence", "uncertainty", "margin")))


def inference_summary(scores: DataFrame, pixel_m2: float = 100.0) -> DataFrame:
    """Per predicted class, pixels, area, mean confidence and uncertainty."""
    return scores.groupBy(F.col("y_pred").alias("class_id")).agg(F.count("*").alias("n"), (F.count("*") * pixel_m2).alias("area_m2"), F.avg("confidence").alias("mean_confidence"), F.avg("uncertainty").alias("mean_uncertainty"))


def equal_matrices(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Largest difference of any cell per matrix, and whether all cells agree."""
    both = one.withColumnRenamed("n", "n1").join(two.withColumnRenamed("n", "n2"), [*keys, "y_true", "y_pred"], "full").na.fill(0, ["n1", "n2"])
    return both.groupBy(*keys).agg(F.max(F.abs(F.col("n1") - F.col("n2"))).alias("max_diff")).withColumn("equal", F.col("max_diff") == 0)


def same_blocks(blocks: DataFrame, run: str = "run_name") -> DataFrame:
    """Per run, blocks that the others have and it hasn't; equal if none."""
    all_blocks, runs = blocks.select("block_id").distinct(), blocks.select(run).distinct()
    n = all_blocks.agg(F.count("*").alias("n_all"))  # one row
    have = blocks.select(run, "block_id").distinct().groupBy(run).agg(F.count("*").alias("n_blocks"))
    return runs.join(have, run).join(F.broadcast(n), how="cross").select(run, "n_blocks", (F.col("n_all") - F.col("n_blocks")).alias("n_missing"), (F.col("n_all") == F.col("n_blocks")).alias("same"))


def same_labels(matrix: DataFrame, keys: list[str], run: str = "run_name") -> DataFrame:
    """Whether all runs of a feature set have the same true pixels per block and class."""
    per = matrix.groupBy(*keys, run, "block_id", "y_true").agg(F.sum("n").alias("n"))
    spread = per.groupBy(*keys, "block_id", "y_true").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k"))
    runs = per.groupBy(*keys).agg(F.count_distinct(run).alias("runs"))
    return spread.join(runs, keys).groupBy(*keys).agg(F.bool_and((F.col("lo") == F.col("hi")) & (F.col("k") == F.col("runs"))).alias("same"))


def attached_blocks(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Predictions with the block of their sample; a label that differs from the sample's raises."""
    both = predictions.join(samples.withColumnRenamed("y_true", "_label"), "sample_id")
    ok = F.when(F.col("_label") == F.col("y_true"), F.col("block_id")).otherwise(F.raise_error(F.lit("label differs from the sample's")).cast("int"))
    return both.withColumn("block_id", ok).drop("_label")


def averaged(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over models of each class's probability; ``scores`` has an array p."""
    long = scores.select(*keys, F.posexplode("p").alias("class_id", "v"))
    return long.groupBy(*keys, (F.col("class_id") + 1).alias("class_id")).agg(F.avg("v").alias("p"))
