"""Scores of trained runs against plain counting."""

import numpy as np
from pyspark.sql import functions as F

from landloom.operators import models as M
from landloom.operators import training as T
from landloom.queries import io
from landloom.queries.samples import samples


def macro_f1(true, pred):
    scores = []
    for k in sorted(set(true) | set(pred)):
        hit = np.sum((true == k) & (pred == k))
        scores.append(2 * hit / max(np.sum(true == k) + np.sum(pred == k), 1))
    return float(np.mean(scores))


def test_runs_of_a_grid_have_scores_of_both_splits(spark, sf):
    got = {r.run_name: (r.val_f1, r.test_f1, r.val_loss) for r in io.m05_m08_grid_of_runs(spark, sf).collect()}
    runs = M.grid(M.prepared(samples(spark, sf), "ae").cache(), "forest", 64, {"maxDepth": [3, 4]}, [11, 12]).toPandas()
    assert len(got) == 4
    for name, run in runs.groupby("run_name"):
        val, test = (run[run.split == s] for s in ("val", "test"))
        want = macro_f1(val.y_true.to_numpy(), val.y_pred.to_numpy()), macro_f1(test.y_true.to_numpy(), test.y_pred.to_numpy()), float(np.mean(val.y_true != val.y_pred))
        assert np.allclose(got[name], want, atol=2e-6)
    assert any(abs(v - t) > 1e-6 for v, t, _ in got.values())


KIND = "split string, label int, weight double, features array<double>, sample_id long"


def labelled(spark, n, seed, val=0.0, noise=False):
    """Rows of three classes that two of four features tell apart, class 2 being rare; ``noise`` shuffles the labels of validation rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    label = np.where(x[:, 0] + x[:, 1] > 1.6, 2, (x[:, 0] > 0).astype(int))
    split = np.where(rng.random(n) < val, "val", "train")
    if noise:
        label = np.where(split == "val", rng.integers(0, 3, n), label)
    weight = 1.0 / np.bincount(label, minlength=3)[label] * n / 3
    rows = [(str(s), int(k), float(w), [float(v) for v in f], i) for i, (s, k, w, f) in enumerate(zip(split, label, weight, x, strict=True))]
    return x, label, split, weight, spark.createDataFrame(rows, KIND).repartition(3)


def plain_trees(x, label, weight, edges, rounds, depth, rate, classes=3):
    """Scores of softmax boosting, grown one node after the other over all cuts."""
    bins = np.stack([np.searchsorted(e, v) for e, v in zip(edges, x.T, strict=True)], axis=1)
    score = np.zeros((len(x), classes))
    for _ in range(rounds):
        p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        moved = np.zeros_like(score)
        for k in range(classes):
            g, h = weight * (p[:, k] - (label == k)), weight * p[:, k] * (1 - p[:, k])

            def grow(rows, left, k=k, g=g, h=h):
                value = -g[rows].sum() / (h[rows].sum() + 1)
                best = (1e-6, None)
                for f in range(x.shape[1]) if left else ():
                    for cut in range(len(edges[f])):
                        a, b = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                        if h[a].sum() >= 1e-3 and h[b].sum() >= 1e-3:
                            gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                            if gain > best[0] + 1e-12:
                                best = (gain, (a, b))
                if best[1]:
                    for part in best[1]:
                        grow(part, left - 1)
                else:
                    moved[rows, k] = rate * value

            grow(np.arange(len(x)), depth)
        score = score + moved
    return score


def test_boosted_trees_equal_plain_boosting(spark):
    x, label, _, weight, data = labelled(spark, 260, 1)
    edges = np.quantile(x, np.arange(1, 8) / 8, axis=0).T
    trees = T.boosted(data, 4, 3, rounds=3, depth=2, rate=0.5, bins=8, edges=edges)
    assert len(trees.rounds) == 3 and not trees.losses
    want = plain_trees(x, label, weight, edges, 3, 2, 0.5)
    assert np.allclose(trees.scores(x, 3), want, atol=1e-9)
    got = {r.sample_id: r.prediction for r in T.called(data, lambda v: trees.scores(v, 3)).collect()}
    assert got == dict(enumerate(want.argmax(axis=1).tolist())) and np.mean(want.argmax(axis=1) == label) > 0.85


def test_boosting_ends_by_validation_rows_and_heeds_weights(spark):
    *_, noise = labelled(spark, 300, 2, 0.4, True)
    ended = T.boosted(noise, 4, 3, rounds=12, depth=1, rate=0.8, bins=8, patience=2)
    least = int(np.argmin(ended.losses))
    assert len(ended.losses) == least + 3 < 12 and len(ended.rounds) == max(1, least)
    x, label, split, _, good = labelled(spark, 400, 3, 0.3)
    run = T.boosted(good, 4, 3, rounds=5, depth=2, rate=0.5, bins=8)
    assert len(run.rounds) == 5 and run.losses == sorted(run.losses, reverse=True) and len(run.losses) == 6
    even = T.boosted(good.withColumn("weight", F.lit(1.0)), 4, 3, rounds=1, depth=1, bins=8)
    heavy = T.boosted(good.withColumn("weight", F.when(F.col("label") == 2, 50.0).otherwise(1.0)), 4, 3, rounds=1, depth=1, bins=8)
    assert (heavy.scores(x, 3).argmax(axis=1) == 2).mean() > (even.scores(x, 3).argmax(axis=1) == 2).mean() + 0.1


def test_gradient_of_the_perceptron(spark):
    rng = np.random.default_rng(5)
    layers = [(rng.normal(size=(3, 4)), rng.normal(size=3)), (rng.normal(size=(2, 3)), rng.normal(size=2))]
    x, label, weight = rng.normal(size=(7, 4)), rng.integers(0, 2, 7), rng.uniform(0.5, 2, 7)

    def loss(layers):
        return -(weight * np.log(T.softmax(T.forward(x, layers)[-1])[np.arange(7), label])).sum()

    flat = T.gradient(x, label, weight, layers)
    at = 0
    for values in (v for layer in layers for v in layer):
        for place in np.ndindex(values.shape):
            old = values[place]
            values[place] = old + 1e-6
            up = loss(layers)
            values[place] = old - 1e-6
            assert abs((up - loss(layers)) / 2e-6 - flat[at]) < 1e-4
            values[place], at = old, at + 1
    assert at == len(flat)


def test_perceptron_learns_by_class_weights_and_validation(spark):
    x, label, split, _, data = labelled(spark, 500, 7, 0.3)
    settings = {"hidden": [12], "classes": 3, "epochs": 12, "batches": 2, "rate": 0.05}
    layers = T.perceptron(data, 4, **settings)
    right = T.forward(x, layers)[-1].argmax(axis=1) == label
    assert right[split == "val"].mean() > 0.85
    rare = {}
    for name, w in (("even", F.lit(1.0)), ("heavy", F.when(F.col("label") == 2, 40.0).otherwise(1.0))):
        made = T.perceptron(data.withColumn("weight", w), 4, **{**settings, "epochs": 2})
        rare[name] = (T.forward(x, made)[-1].argmax(axis=1) == 2).mean()
    assert rare["heavy"] > rare["even"] + 0.1
    noise = labelled(spark, 300, 2, 0.4, True)[-1]
    assert len(T.perceptron(noise, 4, [3], 3, epochs=3, batches=1, patience=1)) == 2
