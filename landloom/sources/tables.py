"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself, or an error that names the columns it lacks."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] = ()) -> DataFrame:
    """A CSV table with a header and a known schema."""
    return require_columns(spark.read.schema(schema).option("header", True).csv(path), list(required))


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Summary files of runs, one row each with its path; broken files are skipped."""
    df = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)
    return df.withColumn("path", F.col("_metadata.file_path"))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table as Parquet, or as gzipped CSV."""
    w = df.write.mode("overwrite")
    if kind == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("compression", "gzip").csv(path)


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table that ``write_table`` wrote."""
    return spark.read.schema(schema).parquet(path) if kind == "parquet" else read_csv(spark, path, schema)


def write_samples(samples: DataFrame, statistics: DataFrame, meta: dict[str, str], path: str) -> None:
    """Samples by split, statistics of features, and facts about them."""
    samples.write.mode("overwrite").partitionBy("split").parquet(f"{path}/samples")
    statistics.coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")  # one row per feature
    samples.sparkSession.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def write_raster(pixels: DataFrame, path: str, size: int) -> None:
    """Pixels by year and row of tiles, all in order of place.

    Ranges of tile rows, not single ones, make a file, so that their number is
    that of tasks however high the raster is; windows skip files and parts of
    files by the least and greatest ``tile_r`` in them.
    """
    keyed = pixels.withColumn("tile_r", F.expr(f"px_row div {size}"))
    place = ["year", "tile_r", "px_row", "px_col"]
    keyed.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A report of few rows as one CSV file with fixed columns, with a header even if empty."""
    rows.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: type, path, name, parent and size.  Contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return f.select(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1).alias("type"), "path", name.alias("name"), F.element_at(parts, -2).alias("parent"), F.col("length").alias("size"))


def file_roles(spark: SparkSession, roles: dict[str, str] | DataFrame, files: DataFrame) -> DataFrame:
    """Inputs and outputs of runs by role (a dictionary, or a table of role and name), and whether each file is there."""
    r = roles if isinstance(roles, DataFrame) else spark.createDataFrame(sorted(roles.items()), "role string, name string")
    return r.join(files.select("name", "path", "size"), "name", "left").withColumn("present", F.col("path").isNotNull())


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """nested fields as columns with dotted names; lists as JSON text."""
    from pyspark.sql import types as T

    def walk(schema: T.StructType, at: tuple[str, ...]) -> list:
        out = []
        for f in schema.fields:
            path = (*at, f.name)
            column = F.col(".".join(f"`{p}`" for p in path))
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, path)
            else:
                out.append((F.to_json(column) if isinstance(f.dataType, T.ArrayType) else column).alias(separator.join(path)))
        return out

    return df.select(*walk(df.schema, ()))
