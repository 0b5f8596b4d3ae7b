"""WARC records and the audit of their copies by Merkle trees."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.llm.common import written

#: Children of a node, as a power of 2, so that ids are cut by shifts and none is rounded.
FANOUT_BITS = 4
#: Records of one segment; two levels of nodes.
SEGMENT_BITS = 2 * FANOUT_BITS
SEGMENT_RECORDS = 1 << SEGMENT_BITS
#: Bytes that are read at a time, and bytes of bodies that a batch of records holds.
STEP_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """WARC resource records of pages: record_id, record.

    Null addresses and bodies are empty.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).cast("long").alias("record_id"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def pieces(stream: pa.NativeFile) -> Iterator[tuple[int | None, bytes]]:
    """Pieces of a plain or gzipped file: the offset of the gzip member they are from, none if plain, and their bytes."""
    data = stream.read(STEP_BYTES)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield None, data
            data = stream.read(STEP_BYTES)
        return
    at, member, inflate = 0, 0, zlib.decompressobj(31)
    while data:
        out = inflate.decompress(data, STEP_BYTES)
        if out:
            yield member, out
        at += len(data)
        data = inflate.unused_data or inflate.unconsumed_tail
        at -= len(data)
        if inflate.eof:
            member, inflate = at, zlib.decompressobj(31)
        data = data or stream.read(STEP_BYTES)


def warc_records(stream: pa.NativeFile) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, head and body of each record, one in memory at a time.

    The offset is that of the record in a plain file and of its gzip member in
    a gzipped one.  What is no record is passed over; a record whose file ends
    before its body does has the bytes there are.
    """
    source, held, marks, passed, ended = pieces(stream), bytearray(), [], 0, False

    def more() -> bool:
        nonlocal ended
        got = next(source, None)
        ended = got is None
        if got is not None:
            marks.append((passed + len(held), got[0]))
            held.extend(got[1])
        return not ended

    def drop(n: int) -> None:
        nonlocal passed
        passed += n
        del held[:n]
        while len(marks) > 1 and marks[1][0] <= passed:
            marks.pop(0)

    while True:
        while (start := held.find(b"WARC/1.")) < 0 and not ended:
            drop(max(len(held) - 6, 0))
            more()
        if start < 0:
            return
        drop(start)
        while (head_end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if head_end < 0:
            return
        offset = passed if marks[0][1] is None else marks[0][1]
        lines = bytes(held[:head_end]).decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = head.get("content-length", "")
        end = head_end + 4 + (int(size) if size.isdigit() else 0)
        while len(held) < end and more():
            pass
        body = bytes(held[head_end + 4 : end])
        drop(min(end, len(held)))
        yield offset, head, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped: file, record_offset, record_type, uri, body.

    Each file is streamed in its task, record after record (see
    ``warc_records``); equal records stay; a folder without files is an error
    of the scan, a file without records gives no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "record_offset", "record_type", "uri", "body"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for offset, head, body in warc_records(stream):
                        rows.append((name, offset, head.get("warc-type"), head.get("warc-target-uri"), body))
                        held += len(body)
                        if held > BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.repartition("path").mapInArrow(run, "file string, record_offset long, record_type string, uri string, body binary")


def leaves(records: DataFrame) -> DataFrame:
    """Leaf of each record id: segment, slot, record_id, n, bytes, hash.

    A segment holds the ids of one range and a slot one id, so that a record
    lost from a replica moves no other leaf; a null id has a null segment.  The
    hash of an id that occurs more than once is made of sums of its records'
    hashes, which need no order.
    """
    digest = F.sha2("record", 256)
    part = [F.conv(F.substring("_h", 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)") for k in range(5)]
    one = records.select("record_id", digest.alias("_h"), F.octet_length("record").cast("long").alias("_b"))
    sums = one.groupBy("record_id").agg(F.count("*").alias("n"), F.sum("_b").alias("bytes"), F.min("_h").alias("_one"), *(F.sum(p).cast("string").alias(f"_s{k}") for k, p in enumerate(part)))
    joint = F.sha2(F.concat_ws(",", F.col("n").cast("string"), *(F.col(f"_s{k}") for k in range(5))), 256)
    named = sums.withColumn("hash", F.when(F.col("n") == 1, F.col("_one")).otherwise(joint))
    return named.select(F.shiftright("record_id", SEGMENT_BITS).alias("segment"), F.col("record_id").bitwiseAND(F.lit(SEGMENT_RECORDS - 1)).alias("slot"), "record_id", "n", "bytes", "hash")


def offsets(leaf: DataFrame) -> DataFrame:
    """Leaves with the byte offset of their record in the segment; a segment is a bounded number of rows."""
    before = Window.partitionBy("segment").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))


def tree(leaf: DataFrame, levels: int) -> DataFrame:
    """Nodes (level, node, bytes, hash) of the tree over all leaves, ``levels`` levels above them.

    The number of a leaf is its record id; node k of a level covers the ids
    whose first bits are k, an ordered range of records and of offsets.  The
    hash of a node is that of its children's numbers, offset ranges, which
    begin at 0 in each node, and hashes in order.  A null id has null nodes
    on all levels.
    """
    now = leaf.select(F.lit(0).alias("level"), F.col("record_id").alias("node"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("hash", F.lit("")).alias("hash"))
    nodes = [now]
    for level in range(1, levels + 1):
        child = F.struct(F.col("node").alias("k"), F.col("bytes").alias("b"), F.col("hash").alias("h"))
        children = now.groupBy(F.shiftright("node", FANOUT_BITS).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"))
        ends = F.aggregate("c", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["b"])))
        children = children.withColumn("e", ends)
        text = F.array_join(F.transform("c", lambda x, i: F.concat_ws(":", F.coalesce(x["k"].cast("string"), F.lit("null")), F.concat_ws("-", F.get("e", i), F.get("e", i + 1)), x["h"])), ",")
        now = children.select(F.lit(level).alias("level"), F.col("up").alias("node"), F.element_at("e", -1).alias("bytes"), F.sha2(F.concat(F.lit("node "), text), 256).alias("hash"))
        nodes.append(now)
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    return out


def audit(copy_a: DataFrame, copy_b: DataFrame) -> DataFrame:
    """Where two replicas of records (record_id, record) differ, located by their trees.

    Returns segment, record_id, offset, bytes, state (changed, missing or extra
    in b), hash_a and hash_b; offset and bytes are those in a, or in b for an
    extra record.  Roots are compared first; then only the children of nodes
    that differ are read, level by level, down to the leaves.  Equal replicas
    give no row, as do two empty ones.  A null record id is an id of its own,
    without a segment; a null record has the empty hash and no bytes; records
    of one id, whose order says nothing, share a leaf and an offset; other
    columns are not read.  Any long is an id: the tree has 16 levels at most.
    """
    a, b = (written(offsets(leaves(x)), "merkle-leaves") for x in (copy_a, copy_b))
    ids = a.select("record_id").unionByName(b.select("record_id"))
    far = ids.agg(F.greatest(F.max("record_id"), -(F.min("record_id") + 1))).first()[0] or 0
    levels = 1
    while far >> FANOUT_BITS * levels:
        levels += 1
    trees = [written(tree(x, levels), "merkle-tree") for x in (a, b)]
    differ = None
    for level in range(levels, -1, -1):
        here = [t.filter(F.col("level") == level).select(F.col("node").alias(f"node_{k}"), F.col("hash").alias(f"hash_{k}")) for t, k in zip(trees, "ab", strict=True)]
        if differ is not None:  # descend below the nodes that differ only
            here = [h.join(differ.select(F.col("node").alias("up")), F.shiftright(f"node_{k}", FANOUT_BITS).eqNullSafe(F.col("up")), "left_semi") for h, k in zip(here, "ab", strict=True)]
        both = here[0].join(here[1], F.col("node_a").eqNullSafe(F.col("node_b")), "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        differ = written(both.select(F.coalesce("node_a", "node_b").alias("node"), "hash_a", "hash_b"), "merkle-differ")
    place = [x.select(F.col("record_id").alias(f"id_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("segment", "offset", "bytes"))) for x, k in zip((a, b), "ab", strict=True)]
    found = differ.join(place[0], F.col("node").eqNullSafe(F.col("id_a")), "left").join(place[1], F.col("node").eqNullSafe(F.col("id_b")), "left")
    state = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    first = {c: F.when(F.col("hash_a").isNotNull(), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(c) for c in ("segment", "offset", "bytes")}
    return found.select(first["segment"], F.col("node").alias("record_id"), first["offset"], first["bytes"], state.alias("state"), "hash_a", "hash_b")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with faults at fixed record ids: a cut tail, a changed letter, a lost record."""
    k, r = F.col("record_id"), F.col("record")
    fault = F.when(k % 97 == 5, F.substring(r, F.lit(1), F.length(r) - 7)).when(k % 89 == 3, F.concat(F.substring(r, F.lit(1), F.length(r) - 5), F.lit("·"), F.substring(r, F.length(r) - 3, F.lit(4)))).otherwise(r)
    return records.filter((k % 101 != 11) | k.isNull()).select("record_id", fault.alias("record"))


AUDIT_SQL = f"""
WITH a AS (
  SELECT page_id AS record_id,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM pages),
b AS (
  SELECT record_id, CASE WHEN record_id % 97 = 5 THEN substr(r, 1, length(r) - 7)
                         WHEN record_id % 89 = 3 THEN substr(r, 1, length(r) - 5) || chr(183) || substr(r, length(r) - 3, 4) ELSE r END AS r
  FROM a WHERE record_id % 101 <> 11),
o AS (SELECT record_id, record_id // {SEGMENT_RECORDS} AS segment, strlen(r) AS bytes, sha256(r) AS h,
             coalesce(sum(strlen(r)) OVER (PARTITION BY record_id // {SEGMENT_RECORDS} ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM a)
SELECT o.segment, o.record_id, o.off AS "offset", o.bytes, CASE WHEN b.record_id IS NULL THEN 'missing' ELSE 'changed' END AS state,
       o.h AS hash_a, sha256(b.r) AS hash_b
FROM o LEFT JOIN b USING (record_id) WHERE b.record_id IS NULL OR sha256(b.r) <> o.h"""
