"""Mosaics that survive failed tasks, broken batches and batches that are run twice."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from landloom.streaming import incremental as I

SCHEMA = "px_row long, px_col long, value int, delivery int"


def tiles(spark, delivery, rows, value):
    return spark.createDataFrame([(r, c, value + c, delivery) for r in rows for c in range(3)], SCHEMA)


def pixels(spark, at, schema):
    return sorted((r.px_row, r.px_col, r.value, r.delivery) for r in I.read_mosaic(spark, at, schema).collect())


def test_a_task_that_fails_in_mid_write_loses_no_row(spark, tmp_path):
    at, first = f"{tmp_path}/mosaic", tiles(spark, 1, range(40), 100)
    assert pixels(spark, at, first.schema) == []
    I.merge_tiles(first, 0, at, 4)
    before = pixels(spark, at, first.schema)
    assert len(before) == 120
    good = tiles(spark, 2, range(0, 40, 2), 500)
    broken = good.repartition(8, "px_row").withColumn("value", F.when(F.col("px_row") == 38, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        I.merge_tiles(broken, 1, at, 4)
    assert pixels(spark, at, first.schema) == before
    I.merge_tiles(good, 1, at, 4)
    want = [(r, c, 500 + c if r % 2 == 0 else 100 + c, 2 if r % 2 == 0 else 1) for r in range(40) for c in range(3)]
    assert pixels(spark, at, first.schema) == want


def test_a_batch_whose_data_are_written_but_not_its_manifest(spark, tmp_path, monkeypatch):
    at, source, done = f"{tmp_path}/mosaic", f"{tmp_path}/in", f"{tmp_path}/done"
    first = tiles(spark, 1, range(8), 10)
    run = lambda: I.update_mosaic(spark, source, first.schema, at, done, 4).awaitTermination()
    first.write.parquet(source)
    run()
    tiles(spark, 2, range(3), 90).write.mode("append").parquet(source)
    whole = I._manifest
    calls = []

    def failing(spark, target, before=None):
        calls.append(before)
        found = whole(spark, target, before)
        return found.withColumn("tile_r", F.raise_error(F.lit("no manifest")).cast("long")) if found is not None else found

    monkeypatch.setattr(I, "_manifest", failing)
    with pytest.raises(Exception, match="no manifest"):
        run()
    monkeypatch.setattr(I, "_manifest", whole)
    assert calls and pixels(spark, at, first.schema) == sorted(map(tuple, first.collect()))
    run()
    want = [(r, c, (90 if r < 3 else 10) + c, 2 if r < 3 else 1) for r in range(8) for c in range(3)]
    assert pixels(spark, at, first.schema) == want


def test_a_batch_that_runs_twice_or_late_changes_nothing_else(spark, tmp_path):
    at, a, b = f"{tmp_path}/mosaic", tiles(spark, 5, range(8), 10), tiles(spark, 4, range(4, 12), 70)
    I.merge_tiles(a, 0, at, 4)
    I.merge_tiles(b, 1, at, 4)
    once = pixels(spark, at, a.schema)
    I.merge_tiles(b, 1, at, 4)  # again, from the state before it
    assert pixels(spark, at, a.schema) == once == [(r, c, (10 if r < 8 else 70) + c, 5 if r < 8 else 4) for r in range(12) for c in range(3)]
    assert len(glob.glob(f"{at}/manifests/batch=1/attempt=*")) == 2
    old = {r.version for r in I.outdated_versions(spark, at).collect()}
    assert len(old) == 1 and len(os.listdir(f"{at}/data")) == 3


def test_an_empty_batch_keeps_the_mosaic(spark, tmp_path):
    at, a = f"{tmp_path}/mosaic", tiles(spark, 1, range(5), 10)
    I.merge_tiles(a.filter("false"), 0, at, 4)
    I.merge_tiles(a, 1, at, 4)
    I.merge_tiles(a.filter("false"), 2, at, 4)
    assert pixels(spark, at, a.schema) == sorted(map(tuple, a.collect()))
