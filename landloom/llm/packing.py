"""Packing of documents into sequences of bounded length.

Shortest-pack-first over the histogram of piece lengths: only the histogram, at
most ``max_len`` numbers, reaches the driver.  Pieces meet their places by the
rank they have among the pieces of their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landloom.llm.common import written
from landloom.llm.tokens import crc32, encoded, encoder

#: Pieces of one length that one task ranks, and buckets of them that are summed up together.
RANK_ROWS, SUM_BUCKETS = 1_000, 1_000


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[int, list[int]]]:
    """Patterns ``(how often, lengths)`` that hold every piece once.

    Lengths are placed from the longest down.  Pieces of a length go into the
    packs with the least in them so far, if those have room, all packs of a
    pattern at a time; what finds no room opens new packs.  Each step uses up
    the pieces of a length or the packs of a pattern, so that there are few
    patterns: at most one more for each length than steps that use up a pattern.
    """
    open_packs: list[tuple[int, int, int, list[int]]] = []  # fill, age, how often, lengths
    age = 0
    for length in sorted(counts, reverse=True):
        left, fresh = counts[length], []
        while left > 0 and open_packs and open_packs[0][0] + length <= max_len:
            fill, _, often, lengths = heapq.heappop(open_packs)
            used = min(left, often)
            left -= used
            fresh.append((fill + length, used, [*lengths, length]))
            if often > used:
                heapq.heappush(open_packs, (fill, age := age + 1, often - used, lengths))
            if fill + 2 * length <= max_len and left:  # the same pack may take another piece of this length
                total, used, lengths = fresh.pop()
                heapq.heappush(open_packs, (total, age := age + 1, used, lengths))
        if left > 0:
            each = max_len // length
            for n, k in ((left // each, each), (1 if left % each else 0, left % each)):
                if n:
                    fresh.append((length * k, n, [length] * k))
        for fill, often, lengths in fresh:
            heapq.heappush(open_packs, (fill, age := age + 1, often, lengths))
    return [(often, lengths) for _, _, often, lengths in sorted(open_packs, key=lambda p: (-p[0], p[1]))]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: a row for each length in each pattern.

    Pieces ``first`` up to the next row's ``first`` of a ``length`` go to the
    sequences from ``sequence`` on, ``each`` of them side by side from ``offset``.
    """
    rows, given, sequence = [], {}, 0
    for often, lengths in patterns:
        at = 0
        while at < len(lengths):
            length, each = lengths[at], lengths.count(lengths[at])
            rows.append((length, given.get(length, 0), each, sequence, sum(lengths[:at])))
            given[length] = given.get(length, 0) + each * often
            at += each
        sequence += often
    rows.sort()
    return dict(zip(("length", "first", "each", "sequence", "offset"), np.array(rows or np.empty((0, 5)), np.int64).T, strict=True))


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``max_len`` ids: doc_id, start, length, ids_crc32, doc_tokens.

    All pieces of a document but its last one are full.
    """
    some = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = some.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, ids in encoded(encoder(tokenizer_path), batch.column(1), end_id):
                out += [(row, at, min(max_len, len(ids) - at), crc32(ids[at : at + max_len]), len(ids)) for at in range(0, len(ids), max_len)]
            made = [pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [()] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return some.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(rows: DataFrame, by: str, order: list[str], counts: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, among the rows that share ``by``.

    ``counts`` has ``by`` and ``count``.  Rows of a common value are dealt to
    as many buckets as their number asks for and ranked inside these; a bucket's
    first rank is a running sum over buckets, taken in parts and over the parts,
    so no task holds a hot value, nor all its buckets.
    """
    buckets = counts.select(by, F.ceil(F.col("count") / RANK_ROWS).cast("int").alias("_n"))
    dealt = written(rows.join(F.broadcast(buckets), by).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_n"))).drop("_n"), "ranked")
    counts = dealt.groupBy(by, "_bucket").count().withColumn("_part", F.floor(F.col("_bucket") / SUM_BUCKETS))

    def before(*keys: str, along: str) -> F.Column:
        return F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = counts.groupBy(by, "_part").agg(F.sum("count").alias("count")).select(by, "_part", before(by, along="_part").alias("_base"))
    first = counts.withColumn("_first", before(by, "_part", along="_bucket")).join(parts, [by, "_part"]).select(by, "_bucket", (F.col("_first") + F.col("_base")).alias("_first"))
    inside = Window.partitionBy(by, "_bucket").orderBy(*order)
    return dealt.withColumn("rank", F.row_number().over(inside) - 1).join(first, [by, "_bucket"]).withColumn("rank", F.col("rank") + F.col("_first")).drop("_bucket", "_first")


def placed(parts: DataFrame, max_len: int) -> DataFrame:
    """Adds sequence_id and offset to ``parts`` (see ``pieces``)."""
    counts = parts.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}  # max_len rows at most
    at = slots(pack_histogram(histogram, max_len))
    key = at["length"] * (1 << 44) + at["first"]
    small = parts.sparkSession.createDataFrame([*histogram.items()] or [(0, 0)], "length long, count long")
    rows = ranked(parts, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"], small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            nth = rank - at["first"][k]
            sequence, offset = at["sequence"][k] + nth // at["each"][k], at["offset"][k] + nth % at["each"][k] * length
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank")
    return rows.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_len: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place whole documents in sequences of at most ``max_len`` ids.

    A document's ids and its end id are cut into full pieces and a last, shorter
    one; each id is in one piece.  Returns doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset per piece; the pieces of a sequence follow
    each other from offset 0 without a gap.  A null or empty text is one piece
    with the end id alone; repeated rows are packed as often as they occur; an
    empty table gives no row; other columns are not read.
    """
    parts = written(pieces(docs, tokenizer_path, end_id, max_len, id_col, text_col), "pieces")
    return placed(parts, max_len).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
