"""Training whose sums are made by Spark: boosted trees of many classes, and a perceptron with class weights.

Rows stay in tasks.  What the driver holds is the model and sums of its size:
histograms of nodes, or one gradient.  Rounds and epochs are chosen by
validation rows, and training ends when these no longer gain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.sources.shared import folder, written

#: Least gain and least weight of curvature on a side for a split, and the ridge on leaves.
LEAST_GAIN, LEAST_WEIGHT, RIDGE = 1e-6, 1e-3, 1.0

_SUMS = "key long, g double, h double"


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix(lists: pa.Array) -> np.ndarray:
    """A column of lists of equal length as rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def summed(rows: DataFrame, per_task: Callable[[Iterator[pa.RecordBatch]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys with the sums of what ``per_task`` gives for each task (keys, g, h), by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, g, h = per_task(batches)
        some = np.flatnonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(key)[some], pa.int64()), pa.array(g[some]), pa.array(h[some])], ["key", "g", "h"])

    t = rows.mapInArrow(run, _SUMS).groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    return tuple(t[c].to_numpy() for c in ("key", "g", "h"))


@dataclass
class Trees:
    """Boosted trees: for every round a tree (feature, cut, leaf) per class, on bins that ``edges`` bound.

    A tree is complete: node k has children 2k + 1 and 2k + 2; a row goes right
    if its bin of the node's feature is above the cut; feature -1 sends all left.
    """

    edges: np.ndarray
    depth: int
    rounds: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of features; null and NaN are in the first one."""
        return np.stack([np.searchsorted(e, np.where(np.isnan(v), -np.inf, v)) for e, v in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def scores(self, x: np.ndarray, classes: int) -> np.ndarray:
        bins, out = self.binned(x), np.zeros((len(x), classes))
        for trees in self.rounds:
            out += np.stack([leaf[places(bins, feature, cut, self.depth)] for feature, cut, leaf in trees], axis=1)
        return out


def places(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node at ``depth`` that each row comes to."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(depth):
        node = (1 << level) - 1 + at
        f = feature[node]
        at = 2 * at + ((f >= 0) & (bins[rows, f] > cut[node]))
    return at


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[int, int, float, float]:
    """Feature and cut that gain most from a node's histograms (features, bins), and the leaf values on both sides."""
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - total_g**2 / (total_h + RIDGE)
    gain = np.where((left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT), gain, -1.0)
    at = int(gain.argmax()) if gain.size else 0
    if not gain.size or gain.flat[at] <= LEAST_GAIN:
        return -1, 0, -total_g / (total_h + RIDGE), 0.0
    f, b = np.unravel_index(at, gain.shape)
    return int(f), int(b), -left_g[f, b] / (left_h[f, b] + RIDGE), -right_g[f, b] / (right_h[f, b] + RIDGE)


def quantile_edges(rows: DataFrame, n_features: int, bins: int) -> np.ndarray:
    """Bounds between bins of about equally many training rows, for each feature; one row reaches the driver."""
    at = [k / bins for k in range(1, bins)]
    got = rows.agg(*(F.percentile_approx(F.col("features")[k], at, 10_000).alias(f"e{k}") for k in range(n_features))).first()
    return np.array([got[k] if got[k] is not None else [0.0] * (bins - 1) for k in range(n_features)], float)


def boosted(data: DataFrame, n_features: int, classes: int = 10, rounds: int = 50, depth: int = 3, rate: float = 0.3, bins: int = 32, patience: int = 5, edges: np.ndarray | None = None) -> Trees:
    """One softmax ensemble of trees for all classes, fitted on rows of split train and ended by those of split val.

    ``data`` has split, label (from 0), weight and features (array).  Each round
    fits a tree per class to gradient and curvature of the weighted log loss; a
    level of all its trees is one job, in which tasks sum histograms per node,
    feature and bin.  It ends when the log loss of validation rows has not
    fallen for ``patience`` rounds, and keeps the rounds up to the least loss, one
    at least; without validation rows it runs all rounds.  Up to 256 bins.
    """
    rows = data.filter("split IN ('train', 'val')").select((F.col("split") == "train").alias("train"), F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), F.col("features").cast("array<double>").alias("features"))
    model = Trees(quantile_edges(rows.filter("train"), n_features, bins) if edges is None else edges, depth)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = model.binned(matrix(b.column(3)).astype(float)) if len(b) else np.empty((0, n_features), np.uint8)
            zero = bytes(8 * classes)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([zero] * len(b), pa.binary())], ["train", "label", "weight", "bins", "score"])

    schema = "train boolean, label int, weight double, bins binary, score binary"
    state = written(rows.mapInArrow(coded, schema), "boosting")

    def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(b), n_features)
        score = np.frombuffer(b"".join(b.column(4).to_pylist()), float).reshape(len(b), classes)
        return b.column(0).to_numpy(zero_copy_only=False).astype(bool), b.column(1).to_numpy(), b.column(2).to_numpy(), codes, score

    def level_sums(trees: list, level: int) -> tuple[np.ndarray, np.ndarray, float | None]:
        """Histograms (class, node, feature, bin) of a level, and the mean loss of validation rows before this round."""
        nodes = 1 << level
        size = classes * nodes * n_features * bins

        def per_task(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
            g, h = np.zeros((2, classes, n_features, nodes * bins))
            loss = weight = 0.0
            for b in batches:
                train, label, w, codes, score = arrays(b)
                p = softmax(score) if len(b) else score
                at = np.flatnonzero(~train)
                loss -= float((w[at] * np.log(np.maximum(p[at, label[at]], 1e-15))).sum())
                weight += float(w[at].sum())
                at = np.flatnonzero(train)
                codes, p, w = codes[at], p[at], w[at]
                slope, curve = p * w[:, None], p * (1 - p) * w[:, None]
                slope[np.arange(len(at)), label[at]] -= w
                for k in range(classes):
                    node = places(codes, trees[k][0], trees[k][1], level) * bins
                    for f in range(n_features):
                        cell = node + codes[:, f]
                        g[k, f] += np.bincount(cell, slope[:, k], nodes * bins)
                        h[k, f] += np.bincount(cell, curve[:, k], nodes * bins)
            turn = lambda x: x.reshape(classes, n_features, nodes, bins).swapaxes(1, 2).ravel()
            return np.append(np.arange(size), -1), np.append(turn(g), loss), np.append(turn(h), weight)

        key, g, h = summed(state, per_task)
        out = np.zeros((2, size))
        known = key >= 0
        out[0, key[known]], out[1, key[known]] = g[known], h[known]
        lost = float(g[~known][0] / h[~known][0]) if (~known).any() and h[~known][0] > 0 else None
        return *out.reshape(2, classes, nodes, n_features, bins), lost

    for _ in range(rounds + 1):
        trees = [(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64), np.zeros(1 << depth)) for _ in range(classes)]
        for level in range(depth):
            g, h, loss = level_sums(trees, level)
            if level == 0:
                if loss is not None:
                    model.losses.append(loss)
                if len(model.rounds) == rounds or (model.losses and len(model.losses) - 1 - int(np.argmin(model.losses)) >= patience):
                    break
            for k, (feature, cut, leaf) in enumerate(trees):
                for node in range(1 << level):
                    at = (1 << level) - 1 + node
                    feature[at], cut[at], left, right = best_split(g[k, node], h[k, node])
                    first = node << (depth - level)
                    half = 1 << (depth - level - 1)
                    leaf[first : first + half], leaf[first + half : first + 2 * half] = rate * left, rate * right
        else:
            model.rounds.append(trees)

            def moved(batches: Iterator[pa.RecordBatch], trees: list = trees) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    *_, codes, score = arrays(b)
                    score = score + np.stack([leaf[places(codes, feature, cut, depth)] for feature, cut, leaf in trees], axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in score], pa.binary())], b.schema.names)

            state = written(state.mapInArrow(moved, schema), "boosting")
            continue
        break
    if model.losses:
        model.rounds = model.rounds[: max(1, int(np.argmin(model.losses)))]
    return model


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Inputs of every layer and, last, the scores; ReLU between layers."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        x = x @ w.T + b
        x = np.maximum(x, 0) if k < len(layers) - 1 else x
        out.append(x)
    return out


def gradient(x: np.ndarray, label: np.ndarray, weight: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Gradient of the weighted log loss, summed over rows, as one vector: each layer's weights and bias."""
    held = forward(x, layers)
    back = softmax(held[-1]) * weight[:, None]
    back[np.arange(len(x)), label] -= weight
    out = []
    for k in range(len(layers) - 1, -1, -1):
        out = [(back.T @ held[k]).ravel(), back.sum(axis=0), *out]
        back = (back @ layers[k][0]) * (held[k] > 0)
    return np.concatenate(out)


def macro_f1(counts: np.ndarray) -> float:
    """Mean F1 of the classes that occur in a confusion matrix."""
    both = counts.sum(axis=0) + counts.sum(axis=1)
    f1 = 2 * np.diag(counts)[both > 0] / both[both > 0]
    return float(f1.mean()) if len(f1) else 0.0


def perceptron(data: DataFrame, n_features: int, hidden: list[int], classes: int = 10, seed: int = 42, epochs: int = 40, batches: int = 4, rate: float = 0.01, patience: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """A perceptron fitted to the weighted log loss of rows of split train, ended by the macro F1 of those of split val.

    ``data`` has split, label (from 0), weight and features (array).  Training
    rows are dealt to ``batches`` folders by a hash of their values; a step
    reads one of them, its tasks sum gradients and the driver takes one Adam
    step.  The layers of the epoch with the best validation F1 are returned, the
    last epoch's where there are no validation rows.
    """
    rows = data.filter("split IN ('train', 'val')").select(F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), F.col("features").cast("array<double>").alias("features"), "split")
    at, spark = folder(data.sparkSession, "steps"), data.sparkSession
    rows.withColumn("part", F.when(F.col("split") == "val", -1).otherwise(F.pmod(F.xxhash64("features", "label", F.lit(seed)), F.lit(batches)))).drop("split").write.partitionBy("part").parquet(at)
    stored = spark.read.schema("label int, weight double, features array<double>, part int").parquet(at)
    rng = np.random.default_rng(seed)
    sizes = [n_features, *hidden, classes]
    layers = [(rng.normal(size=(b, a)) * np.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    flat = lambda ls: np.concatenate([x for w, b in ls for x in (w.ravel(), b)])

    def shaped(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(sizes[:-1], sizes[1:], strict=True):
            out.append((v[at : at + a * b].reshape(b, a), v[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    n_values = len(flat(layers))

    def slopes(layers: list) -> Callable:
        def per_task(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
            total, weight = np.zeros(n_values), 0.0
            for b in batches:
                if len(b):
                    w = b.column(1).to_numpy()
                    total += gradient(matrix(b.column(2)).astype(float), b.column(0).to_numpy(), w, layers)
                    weight += float(w.sum())
            return np.arange(-1, n_values), np.append(weight, total), np.zeros(n_values + 1)

        return per_task

    def hits(layers: list) -> Callable:
        def per_task(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
            counts = np.zeros(classes * classes)
            for b in batches:
                if len(b):
                    called = forward(matrix(b.column(2)).astype(float), layers)[-1].argmax(axis=1)
                    counts += np.bincount(b.column(0).to_numpy().astype(np.int64) * classes + called, minlength=classes * classes)
            return np.arange(classes * classes), counts, np.zeros(classes * classes)

        return per_task

    value, first, second, step = flat(layers), np.zeros(n_values), np.zeros(n_values), 0
    best, best_f1, since = value, -1.0, 0
    for _ in range(epochs):
        for part in range(batches):
            key, g, _ = summed(stored.filter(F.col("part") == part), slopes(shaped(value)))
            total = np.zeros(n_values + 1)
            total[key + 1] = g
            if total[0] <= 0:
                continue
            slope, step = total[1:] / total[0], step + 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            value = value - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        key, g, _ = summed(stored.filter("part = -1"), hits(shaped(value)))
        counts = np.zeros(classes * classes)
        counts[key] = g
        f1 = macro_f1(counts.reshape(classes, classes)) if len(key) else float("inf")
        if f1 > best_f1 or not len(key):
            best, best_f1, since = value, f1, 0
        else:
            since += 1
            if since >= patience:
                break
    return shaped(best)


def called(data: DataFrame, scores: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Predictions (sample_id, split, label, prediction) by the highest of the scores of features (array)."""
    some = data.select("sample_id", "split", F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scores(matrix(b.column(3)).astype(float)).argmax(axis=1) if len(b) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p, pa.int32())], ["sample_id", "split", "label", "prediction"])

    kinds = {f.name: f.dataType.simpleString() for f in some.schema}
    return some.mapInArrow(run, f"sample_id {kinds['sample_id']}, split {kinds['split']}, label int, prediction int")
