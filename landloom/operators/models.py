"""Classifiers over feature vectors: distributed fitting, scoring and repeated runs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from landloom.operators import training
from landloom.operators.sampling import class_weights


def prepared(samples: DataFrame, features: str) -> DataFrame:
    """Vectors, zero-based labels and class weights of samples, for spark.ml."""
    w = class_weights(samples.filter("split = 'train'")).select("class_id", F.col("balanced").alias("weight"))  # ten rows
    return samples.join(F.broadcast(w), "class_id").select("sample_id", "split", array_to_vector(F.col(features).cast("array<double>")).alias("features"), (F.col("class_id") - 1).cast("double").alias("label"), "weight")


def estimator(kind: str, n_features: int, seed: int, **settings):
    """A classifier of ``spark.ml``: ``linear`` or ``forest``."""
    if kind == "linear":
        return LogisticRegression(weightCol="weight", family="multinomial", **{"maxIter": 30, **settings})
    if kind == "forest":
        return RandomForestClassifier(weightCol="weight", seed=seed, **{"numTrees": 20, **settings})
    raise ValueError(f"unknown kind of classifier: {kind}")


def fit_and_predict(data: DataFrame, kind: str, n_features: int, seed: int = 42, **settings) -> DataFrame:
    """Predictions of a classifier fitted on the training rows: sample_id, split, y_true, y_pred.

    Kinds ``boosted`` and ``perceptron`` (see ``training``) weigh classes and
    end by the validation rows; the others are those of ``estimator``.
    """
    if kind in ("boosted", "perceptron"):
        arrays = data.withColumn("features", vector_to_array("features"))
        if kind == "boosted":
            trees = training.boosted(arrays, n_features, **settings)
            out = training.called(arrays, lambda x: trees.scores(x, 10))
        else:
            layers = training.perceptron(arrays, n_features, seed=seed, **{"hidden": [32], **settings})
            out = training.called(arrays, lambda x: training.forward(x, layers)[-1])
    else:
        out = estimator(kind, n_features, seed, **settings).fit(data.filter("split = 'train'")).transform(data)
    return out.select("sample_id", "split", (F.col("label") + 1).cast("int").alias("y_true"), (F.col("prediction") + 1).cast("int").alias("y_pred"))


def grid(data: DataFrame, kind: str, n_features: int, settings: dict[str, list], seeds: list[int]) -> DataFrame:
    """Predictions of every combination of settings and seeds, with the run's name."""
    out = None
    for values in product(*settings.values()):
        chosen = dict(zip(settings, values, strict=True))
        for seed in seeds:
            name = "_".join([kind, *(f"{k}{v}" for k, v in chosen.items()), f"seed{seed:03d}"])
            one = fit_and_predict(data, kind, n_features, seed, **chosen).withColumn("run_name", F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out


def feature_importance(model, names: list[str], spark) -> DataFrame:
    """Importance of each feature, 0 for one that no tree uses, the highest first."""
    v = model.featureImportances.toArray()
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, v, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def fold_batch_norm(weight: np.ndarray, bias: np.ndarray, gamma: np.ndarray, beta: np.ndarray, mean: np.ndarray, var: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a linear layer with a fixed normalisation behind it as one linear layer."""
    scale = gamma / np.sqrt(var + eps)
    return weight * scale[:, None], (bias - mean) * scale + beta


def scored(pixels: DataFrame, features: str, layers: list[tuple[np.ndarray, np.ndarray]], batch: int = 8192) -> DataFrame:
    """Probabilities of the classes by a perceptron of linear layers with ReLU between.

    A model has a few megabytes, which go to each task once; rows are scored in
    Arrow batches of at most ``batch``.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for at in range(0, len(part), batch):
                x = np.stack(part.iloc[at : at + batch].to_numpy()).astype(float)
                for k, (w, b) in enumerate(layers):
                    x = x @ w.T + b
                    x = np.maximum(x, 0) if k < len(layers) - 1 else x
                e = np.exp(x - x.max(axis=1, keepdims=True))
                out += list(e / e.sum(axis=1, keepdims=True))
            yield pd.Series(out)

    return pixels.withColumn("p", probabilities(F.col(features)))


def require_same_statistics(used: DataFrame, trained: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Number of features and largest difference of two tables of statistics (pos, mu, sigma); raises beyond the tolerance."""
    both = used.alias("p").join(trained.alias("q"), "pos", "full")
    off = F.greatest(F.abs(F.col("p.mu") - F.col("q.mu")), F.abs(F.col("p.sigma") - F.col("q.sigma")))
    worst = F.max(F.coalesce(off, F.lit(float("inf"))))
    row = both.agg(F.count("*").alias("n"), worst.alias("_d"))
    return row.select("n", F.when(F.col("_d") <= tolerance, F.col("_d")).otherwise(F.raise_error(F.lit("statistics differ from those of training")).cast("double")).alias("max_diff"))
