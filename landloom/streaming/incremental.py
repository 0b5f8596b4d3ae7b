"""Incremental work: files that have not been handled yet, and mosaics that are delivered again."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, source: str, schema: StructType, transform, target: str, checkpoint: str) -> StreamingQuery:
    """Handle the files below ``source`` that no earlier call has, then stop.

    The checkpoint remembers what is done, so a call after a failure resumes.
    """
    tiles = spark.readStream.schema(schema).parquet(source)
    return transform(tiles).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at ``path``, if there is one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _manifest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """Which version each row of tiles has (tile_r, version): the newest manifest, or the newest of a batch below ``before``.

    A manifest is one file, so it is there as a whole or not at all.  Those of
    a batch that ran twice are equal in effect; any of them will do.
    """
    found = _if_there(spark, f"{target}/manifests", "tile_r long, version string, batch long, attempt string")
    if found is None:
        return None
    if before is not None:
        found = found.filter(F.col("batch") < before)
    last = found.agg(F.max(F.struct("batch", "attempt")).alias("x")).select("x.*").first()
    return None if last["batch"] is None else found.filter((F.col("batch") == last["batch"]) & (F.col("attempt") == last["attempt"])).select("tile_r", "version")


def _stored(spark: SparkSession, target: str, manifest: DataFrame, columns: str) -> DataFrame:
    """Pixels of the versions that a manifest names; versions that it doesn't name are not read."""
    data = spark.read.schema(f"{columns}, version string, tile_r long").parquet(f"{target}/data")
    return data.join(F.broadcast(manifest), ["version", "tile_r"], "left_semi").drop("version")


def read_mosaic(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """Pixels of the mosaic at ``target`` as the last whole batch left them; no row before the first one."""
    manifest = _manifest(spark, target)
    if manifest is None:
        return spark.createDataFrame([], schema)
    return _stored(spark, target, manifest, _ddl(schema)).drop("tile_r")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def merge_tiles(batch: DataFrame, number: int, target: str, size: int) -> None:
    """One batch of tile pixels (px_row, px_col, value, delivery) into the mosaic at ``target``.

    The rows of tiles that it touches are written as a new version beside the
    old one, and then one manifest file makes them the current one.  Nothing
    that a batch reads is ever replaced, so tasks and executors can fail at any
    point and be run again; what a broken batch has written is in no manifest.
    A batch always starts from the state before its own number, so it can be
    repeated.  Of several deliveries of a pixel the one with the highest number
    wins; of equal numbers the greatest value.
    """
    spark, attempt = batch.sparkSession, uuid.uuid4().hex
    columns, version = batch.columns, f"{number:012d}-{attempt}"
    new = batch.withColumn("tile_r", F.expr(f"px_row div {size}"))
    touched = new.select("tile_r").distinct()
    before = _manifest(spark, target, number)
    if before is not None:
        old = _stored(spark, target, before.join(touched, "tile_r", "left_semi"), _ddl(batch.schema))
        new = new.unionByName(old.select(*new.columns))
    last = new.groupBy("px_row", "px_col", "tile_r").agg(F.max(F.struct("delivery", "value")).alias("x")).select("px_row", "px_col", "x.value", "x.delivery", "tile_r")
    last.select(*columns, "tile_r").repartition("tile_r").write.partitionBy("tile_r").parquet(f"{target}/data/version={version}")
    rows = touched.withColumn("version", F.lit(version))
    if before is not None:
        rows = rows.unionByName(before.join(touched, "tile_r", "left_anti"))
    rows.coalesce(1).write.parquet(f"{target}/manifests/batch={number}/attempt={attempt}")


def update_mosaic(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, size: int) -> StreamingQuery:
    """Merge the tiles delivered below ``source`` since the last call into a mosaic; see ``merge_tiles`` and ``read_mosaic``.

    The stream's checkpoint numbers the batches, so one that failed is run
    again under its own number.
    """
    tiles = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    merged = tiles.writeStream.foreachBatch(lambda batch, number: merge_tiles(batch, number, target, size))
    return merged.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outdated_versions(spark: SparkSession, target: str) -> DataFrame:
    """Versions below ``target``/data that the newest manifest doesn't name, which may be deleted when no reader is left."""
    manifest = _manifest(spark, target)
    every = spark.read.schema("version string, tile_r long").parquet(f"{target}/data").select("version").distinct()
    return every if manifest is None else every.join(F.broadcast(manifest.select("version").distinct()), "version", "left_anti")
