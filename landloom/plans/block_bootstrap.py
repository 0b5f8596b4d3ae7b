"""Block bootstrap end to end: predictions with blocks to intervals, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from landloom.operators import accuracy as A
from landloom.operators import bootstrap as B


def intervals(predictions: DataFrame, saved: DataFrame, keys: list[str], replicates: int, seed: int) -> dict[str, DataFrame]:
    """Intervals per run and class of predictions (keys, block_id, y_true, y_pred).

    ``saved`` are the stored matrices (keys, y_true, y_pred, n); ``gate`` says
    whether the blocks add up to them.
    """
    blocks = A.confusion(predictions, [*keys, "block_id"])
    positions = B.block_positions(blocks)
    n = positions.count()
    reps = B.block_products(blocks.join(positions, "block_id"), n, replicates, seed, keys)
    sums = A.confusion(predictions, keys)
    return {"gate": A.equal_matrices(sums, saved, keys), "runs": B.interval(B.metric_distribution(reps, keys), [*keys, "metric"]), "classes": B.class_intervals(reps, keys, int(replicates * 0.95))}
