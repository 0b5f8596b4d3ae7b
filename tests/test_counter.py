"""Numbers by counter from three engines, and products of weights and blocks."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from landloom.functions import counter as C
from landloom.operators import bootstrap as B


def test_counters_agree_between_engines_and_spread(spark):
    a, b = np.meshgrid(np.arange(300), [0, 1, 2, 77, 2**31, 2**32 - 1], indexing="ij")
    want = C.mixed_numpy(42, a, b)
    rows = spark.createDataFrame(list(zip(a.ravel().tolist(), b.ravel().tolist(), strict=True)), "a long, b long")
    got = {(r.a, r.b): r.h for r in rows.withColumn("h", C.mixed(42, F.col("a"), F.col("b"))).collect()}
    assert got == {(int(x), int(y)): int(h) for x, y, h in zip(a.ravel(), b.ravel(), want.ravel(), strict=True)}
    sql = duckdb.sql(f"SELECT a, b, {C.mixed_sql(42, 'a', 'b')} AS h FROM range(300) x(a), (SELECT unnest([0, 1, 2, 77, 2147483648, 4294967295]) AS b)").fetchall()
    assert {(x, y): h for x, y, h in sql} == got
    many = C.mixed_numpy(7, np.arange(200_000)).astype(float) / 2**32
    assert abs(many.mean() - 0.5) < 0.005 and np.abs(np.histogram(many, 20, (0, 1))[0] / 10_000 - 1).max() < 0.05
    assert len(np.unique(C.mixed_numpy(7, np.arange(1000)[:, None], np.arange(200)[None, :]))) > 199_900


def test_products_equal_the_join_of_draws_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "WEIGHTS", 60)  # several batches, the last one smaller
    rng = np.random.default_rng(3)
    blocks = spark.createDataFrame([(f"r{r}", f"b{k:02d}", int(t), int(p), int(n)) for r in range(2) for k in range(13) for t, p, n in zip(rng.integers(1, 4, 6), rng.integers(1, 4, 6), rng.integers(1, 9, 6), strict=True)], "run_name string, block_id string, y_true int, y_pred int, n long")
    places = B.block_positions(blocks)
    got = B.block_products(blocks.join(places, "block_id"), 13, 23, 42, ["run_name"])
    want = B.replicate_matrices(blocks, places, B.draws(spark, 13, 23, 42), ["run_name"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    per = B.draws(spark, 13, 23, 42).groupBy("replicate").agg(F.count("*").alias("n"), F.max("position").alias("m")).collect()
    assert all(r.n == 13 and r.m < 13 for r in per)
    assert B.block_products(blocks.join(places, "block_id").filter("false"), 13, 23, 42, ["run_name"]).count() == 0
