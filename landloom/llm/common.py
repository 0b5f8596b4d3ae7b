"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step inside a task works on.
CHUNK_BYTES = 4 << 20

#: ASCII white space, which separates words everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster
    that would be a folder of one machine, so the call fails instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "uncompressed") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    Tables of ids and numbers gain little from compression, whose codecs hold
    native memory for each column of each file; tables with texts should ask for it.
    """
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_columns_of(schema: T.StructType, extra: list[tuple[str, T.DataType]]) -> T.StructType:
    """``schema`` with ``extra`` fields behind it, all nullable."""
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in extra])


def fresh_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct integers in order; by sorting, as numpy's own hashing takes far longer."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def text_chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``limit`` bytes of a string column, with their first row.

    Nulls become empty texts.  A text above the limit comes alone.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    row, n, base = 0, len(text), 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield row, text.slice(row, stop - row)
        base, row = int(ends[stop - 1]), stop
        pa.default_memory_pool().release_unused()


def split_long(text: str, limit: int) -> Iterator[str]:
    """Pieces of at least ``limit`` characters that end at ASCII white space."""
    at, n = 0, len(text)
    while at < n:
        end = at + limit
        while end < n and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end


def word_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of every text as codes into a dictionary.

    Returns codes of all words in order, the number of words before each text
    (one more entry than texts), and the dictionary of distinct words.
    """
    lists = pc.ascii_split_whitespace(text.cast(pa.large_string()))
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        flat, owner = flat.filter(full), owner[keep]
    coded = flat.dictionary_encode()
    starts = np.searchsorted(owner, np.arange(len(text) + 1))
    return coded.indices.to_numpy(zero_copy_only=False), starts, coded.dictionary


def per_batch(columns: Callable[[pa.RecordBatch], dict[str, pa.Array]], keep: bool = False) -> Callable:
    """Function for ``mapInArrow`` that makes new columns from each batch.

    With ``keep`` they follow the columns of the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = columns(batch)
            names, arrays = list(made), list(made.values())
            if keep:
                names, arrays = batch.schema.names + names, list(batch.columns) + arrays
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def n_words(text) -> F.Column:
    """Number of words of a text column; 0 for null.  JVM only.

    Of each run of characters outside the ASCII white space its first one stays, of a text of white space alone nothing.
    """
    return F.coalesce(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]?)[^\x20\x09-\x0D]*[\x20\x09-\x0D]*", "$1")), F.lit(0))
