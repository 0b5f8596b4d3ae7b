"""Block bootstrap: draws of blocks, replicate matrices and intervals."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions.counter import below, mixed_numpy
from landloom.operators.accuracy import class_metrics, run_metrics

#: Weights of blocks in replicates that a task holds at a time.
WEIGHTS = 4_000_000


def block_positions(blocks: DataFrame) -> DataFrame:
    """Place, from 0, of each block in order of its name.  There are few blocks: square kilometres, not pixels."""
    return blocks.select("block_id").distinct().withColumn("position", F.row_number().over(Window.orderBy("block_id")) - 1)


def draws(spark, n_blocks: int, replicates: int, seed: int) -> DataFrame:
    """``n_blocks`` positions drawn with replacement per replicate, by counter: the same on any partitioning."""
    slots = spark.range(replicates).select(F.col("id").alias("replicate")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return slots.withColumn("position", below(F.lit(n_blocks), seed, F.col("replicate"), F.col("slot")))


def _weights(first: int, size: int, n_blocks: int, seed: int) -> np.ndarray:
    """How often each of ``size`` replicates from ``first`` on has each position: the counts of ``draws``."""
    at = mixed_numpy(seed, np.arange(first, first + size)[:, None], np.arange(n_blocks)[None, :])
    position = (at * np.uint64(n_blocks)) >> np.uint64(32)
    flat = position.astype(np.int64) + n_blocks * np.arange(size)[:, None]
    return np.bincount(flat.ravel(), minlength=size * n_blocks).reshape(size, n_blocks)


def block_products(blocks: DataFrame, n_blocks: int, replicates: int, seed: int, keys: list[str]) -> DataFrame:
    """B01 to B03 at once: confusion matrices (keys, replicate, y_true, y_pred, n) of all replicates of ``draws``.

    ``blocks`` has keys, position, y_true, y_pred and n.  A task multiplies the
    weights of a batch of replicates, which it draws itself, by the blocks of one
    matrix, blocks times 100 numbers.  So what is shuffled is the blocks once a
    batch, and neither draws nor pairs of blocks and replicates are ever rows.
    """
    batch = max(1, min(WEIGHTS // max(n_blocks, 1), replicates))
    parts = -(-replicates // batch)
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        first = key[-1].as_py() * batch
        size = min(batch, replicates - first)
        true, pred, at, n = (t[c].to_numpy().astype(np.int64) for c in ("y_true", "y_pred", "position", "n"))
        cells, cell = np.unique(np.stack([true, pred], axis=1), axis=0, return_inverse=True)
        held = np.zeros((n_blocks, len(cells)))
        np.add.at(held, (at, cell.ravel()), n)
        got = np.rint(_weights(first, size, n_blocks, seed).astype(float) @ held).astype(np.int64)
        row, col = np.nonzero(got)
        of = [pa.array([k.as_py()] * len(row), t.schema.field(c).type) for c, k in zip(keys, key, strict=False)]
        out = [first + row, cells[col, 0], cells[col, 1], got[row, col]]
        return pa.table([*of, *(pa.array(x, k) for x, k in zip(out, (pa.int64(), t.schema.field("y_true").type, t.schema.field("y_pred").type, pa.int64()), strict=True))], names=[*keys, "replicate", "y_true", "y_pred", "n"])

    spread = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", replicate long, y_true {kinds['y_true']}, y_pred {kinds['y_pred']}, n long"
    return spread.groupBy(*keys, "_part").applyInArrow(run, schema)


def weights(drawn: DataFrame) -> DataFrame:
    """How often each replicate has each position."""
    return drawn.groupBy("replicate", "position").agg(F.count("*").alias("w"))


def replicate_matrices(blocks: DataFrame, positions: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion matrix of each replicate: block matrices times their weights, summed.

    Predictions are summed up to blocks before the join, so its size is that of
    blocks times replicates.
    """
    placed = blocks.join(positions, "block_id")
    return placed.join(weights(drawn), "position").groupBy(*keys, "replicate", "y_true", "y_pred").agg(F.sum(F.col("w") * F.col("n")).alias("n"))


def metric_distribution(replicates: DataFrame, keys: list[str], metrics: tuple[str, ...] = ("accuracy", "macro_f1", "weighted_f1")) -> DataFrame:
    """Metrics of each replicate in percent, one row per metric: by default accuracy, macro and weighted F1."""
    m = run_metrics(replicates, [*keys, "replicate"], missing=None)
    values = F.array(*(F.struct(F.lit(c).alias("metric"), (F.col(c) * 100).alias("value")) for c in metrics))
    return m.select(*keys, "replicate", F.explode(values).alias("x")).select(*keys, "replicate", "x.*")


def interval(values: DataFrame, keys: list[str], low: float = 0.025, high: float = 0.975, column: str = "value") -> DataFrame:
    """Mean, exact percentiles, and numbers of defined and undefined values."""
    q = F.percentile(column, F.array(F.lit(low), F.lit(high)))
    out = values.groupBy(*keys).agg(F.avg(column).alias("mean"), q.alias("_q"), F.count(column).alias("n_valid"), F.count_if(F.col(column).isNull()).alias("n_invalid"))
    return out.select(*keys, "mean", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "n_valid", "n_invalid")


def paired_difference(values: DataFrame, pair: list[str], side: str, first: str, second: str) -> DataFrame:
    """Value of ``second`` less that of ``first`` in the same replicate."""
    a = values.filter(F.col(side) == first).select(*pair, F.col("value").alias("_a"))
    b = values.filter(F.col(side) == second).select(*pair, F.col("value").alias("_b"))
    return a.join(b, pair).select(*pair, (F.col("_b") - F.col("_a")).alias("value"))


def model_gaps(values: DataFrame, best: DataFrame) -> DataFrame:
    """Value of the best model less each other's, per replicate and metric; ``best`` has one run_name."""
    top = values.join(F.broadcast(best.select(F.col("run_name").alias("best"))), F.col("run_name") == F.col("best")).select("replicate", "metric", F.col("value").alias("_best"), "best")
    return values.join(top, ["replicate", "metric"]).filter("run_name <> best").select("replicate", "metric", "run_name", (F.col("_best") - F.col("value")).alias("value"))


def class_intervals(replicates: DataFrame, keys: list[str], least_valid: int) -> DataFrame:
    """Intervals of each class's recall, precision and F1; unstable with too few defined values."""
    m = class_metrics(replicates, [*keys, "replicate"], missing=None)
    values = F.array(*(F.struct(F.lit(c).alias("metric"), (F.col(c) * 100).alias("value")) for c in ("recall", "precision", "f1")))
    long = m.select(*keys, "class_id", F.explode(values).alias("x")).select(*keys, "class_id", "x.*")
    return interval(long, [*keys, "class_id", "metric"]).withColumn("unstable", F.col("n_valid") < least_valid)


def error_bars(table: DataFrame) -> DataFrame:
    """Offsets of an interval from the observed value, its widths and its text."""
    o, lo, hi = F.col("observed"), F.col("lower"), F.col("upper")
    return table.withColumns({"err_low": o - lo, "err_high": hi - o, "half_width": (hi - lo) / 2, "width": hi - lo, "text": F.format_string("%.2f [%.2f, %.2f]", o, lo, hi)})


def _stream(seed: int, key: tuple) -> np.random.Generator:
    """Random numbers of a group's own: the seed with a checksum of its key."""
    return np.random.default_rng([seed, zlib.crc32(repr(tuple(map(str, key))).encode())])


def multinomial_matrices(matrix: DataFrame, keys: list[str], replicates: int, seed: int, batch: int = 250) -> DataFrame:
    """Replicates of whole matrices by multinomial draws over the cells of each row.

    The number of samples of a true class stays; they are drawn anew over the
    predicted classes by the shares that the row has.  Each task draws a batch
    of replicates of one matrix, 100 cells at most, from a stream of its own.
    """
    parts = -(-replicates // batch)
    spread = matrix.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in matrix.schema}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y_true", "y_pred"])
        part, rng = int(key[-1]), _stream(seed, key)
        size = min(batch, replicates - part * batch)
        rows = [p["n"].to_numpy(float) for _, p in pdf.groupby("y_true", sort=True)]
        got = np.hstack([rng.multinomial(int(p.sum()), p / max(p.sum(), 1), size) for p in rows])
        out = pd.DataFrame({c: np.tile(pdf[c].to_numpy(), size) for c in (*keys, "y_true", "y_pred")})
        return out.assign(replicate=np.repeat(np.arange(size) + part * batch, len(pdf)), n=got.ravel())

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "y_true", "y_pred")) + ", replicate long, n long"
    return spread.groupBy(*keys, "part").applyInPandas(run, schema)


def multinomial_areas(areas: DataFrame, keys: list[str], replicates: int, seed: int, pixel_km2: float) -> DataFrame:
    """Mean and 95 percent interval of each class's area per zone and year, each drawn from a stream of its own."""
    kinds = {f.name: f.dataType.simpleString() for f in areas.schema}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class_id")
        p = pdf["n"].to_numpy(float)
        got = _stream(seed, key).multinomial(int(p.sum()), p / max(p.sum(), 1), replicates) * pixel_km2
        return pdf[[*keys, "class_id"]].assign(mean=got.mean(axis=0), lower=np.percentile(got, 2.5, axis=0), upper=np.percentile(got, 97.5, axis=0))

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "class_id")) + ", mean double, lower double, upper double"
    return areas.groupBy(*keys).applyInPandas(run, schema)
