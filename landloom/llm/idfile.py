"""Token-id files with a fixed number of bits per id.

A file holds ``MAGIC``, packed blocks of ``BLOCK_IDS`` ids each (the last one
shorter), an index and the index's length as 8 bytes.  Every id takes the
fewest bits that hold the vocabulary.  The index has the number of bits, of
ids and of documents, the byte offset of each block, and each document's id,
first position and length, and whether it has an id at all.  Any range of ids is read by way of the block offsets.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landloom.llm.common import new_dir, written
from landloom.llm.tokens import encoded, encoder

MAGIC = b"IDBITS02"
#: A multiple of 8, so that every full block ends at a byte.
BLOCK_IDS = 1 << 16
#: A file is closed after the document that reaches this many ids, or this many documents.
SHARD_IDS, SHARD_DOCS = 16 << 20, 1 << 20
#: Characters of a text that decide between tasks where ids are equal.
RANGE_CHARS = 64
#: Documents of a batch of digests.
BATCH_DOCS = 1 << 16


def bits_for(vocab: int) -> int:
    """Fewest bits that hold every id below ``vocab``."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a string of ``bits`` bits each, the highest bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack(data: bytes, bits: int, count: int, skip: int = 0) -> np.ndarray:
    """``count`` ids after the first ``skip`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count, skip * bits // 8).astype("<u4")
    first = skip * bits // 8
    flat = np.unpackbits(np.frombuffer(data, np.uint8)[first : ((skip + count) * bits + 7) // 8])
    flat = flat[skip * bits - first * 8 :][: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype("<u4")


class IdFileWriter:
    """Writes one file; it takes its name only when it is whole.

    A second attempt of a task writes the same bytes, so either may win.
    """

    def __init__(self, url: str, bits: int, attempt: str):
        self.fs, self.path = pafs.FileSystem.from_uri(url)
        self.temp, self.bits = f"{self.path}.{attempt}", bits
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.n_ids = len(MAGIC), 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.blocks: list[int] = []
        self.docs, self.nameless = array("q"), bytearray()
        self.n_docs = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.extend((doc_id or 0, self.n_ids, len(ids)))
        self.nameless.append(doc_id is None)
        self.n_docs += 1
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            self._flush(self.n_waiting // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, n: int) -> None:
        held = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        for k in range(0, n, BLOCK_IDS):
            self.blocks.append(self.at)
            data = pack(held[k : min(k + BLOCK_IDS, n)], self.bits)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.n_waiting = [held[n:]], len(held) - n

    def close(self) -> None:
        self._flush(self.n_waiting)
        index = struct.pack("<4q", self.bits, self.n_ids, self.n_docs, len(self.blocks)) + np.array(self.blocks, "<i8").tobytes() + np.array(self.docs, "<i8").tobytes() + bytes(self.nameless)
        self.out.write(index + struct.pack("<q", len(index)))
        self.out.close()
        self.fs.move(self.temp, self.path)


@dataclass
class IdFile:
    """Random access to one file."""

    url: str

    def __post_init__(self):
        fs, path = pafs.FileSystem.from_uri(self.url)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a token-id file: {self.url}")
        (n_index,) = struct.unpack("<q", self.file.read_at(8, size - 8))
        index = self.file.read_at(n_index, size - 8 - n_index)
        self.bits, self.n_ids, n_docs, n_blocks = struct.unpack_from("<4q", index)
        self.blocks = np.frombuffer(index, "<i8", n_blocks, 32)
        self.docs = np.frombuffer(index, "<i8", 3 * n_docs, 32 + 8 * n_blocks).reshape(n_docs, 3)
        self.nameless = np.frombuffer(index, np.uint8, n_docs, 32 + 8 * n_blocks + 24 * n_docs)

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` up to ``start + count``; only their blocks are read."""
        if count == 0:
            return np.empty(0, "<u4")
        k = start // BLOCK_IDS
        skip = start - k * BLOCK_IDS
        n_bytes = ((skip + count) * self.bits + 7) // 8
        return unpack(self.file.read_at(n_bytes, int(self.blocks[k])), self.bits, count, skip)

    def documents(self, step_ids: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, first position and ids of each document, in the file's order."""
        row, n, ends = 0, len(self.docs), self.docs[:, 1] + self.docs[:, 2]
        while row < n:
            first = int(self.docs[row, 1])
            stop = max(row + 1, int(np.searchsorted(ends, first + step_ids, side="right")))
            ids = self.read(first, int(self.docs[stop - 1, 1:].sum()) - first)
            for (doc, at, count), nameless in zip(self.docs[row:stop].tolist(), self.nameless[row:stop].tolist(), strict=True):
                yield (None if nameless else doc), at, ids[at - first : at - first + count]
            row = stop

    def close(self) -> None:
        self.file.close()


def write_id_files(docs: DataFrame, url: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode whole texts into files below ``url``, in ascending order of id.

    Returns the manifest: part, shard, url, n_docs, n_ids.  Files are in order
    of (part, shard).  Null texts are empty, so each document has its end id at
    least; null ids come first, with ids that are no numbers, which are null;
    equal ids are in order of their texts; an empty table gives no file; ids are
    longs or what casts to them.  A file ends at
    ``shard_ids`` ids or ``shard_docs`` documents, so its index is bounded, and
    very long texts make it no longer than one of them.  Documents are dealt by ranges of id and, within an
    id, of the text's beginning, so rows of one id, or of none, lie in several tasks
    (those that begin alike as well in one, which streams them); a task holds one range and in memory one batch; a lost task is run again and writes the
    same files.
    """
    some = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a text's beginning sorts as the text does, and keeps the bounds of the ranges short
    dealt = some.repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc, rows, out = TaskContext.get(), encoder(tokenizer_path), [], None
        part = task.partitionId()

        def done() -> None:
            out.close()
            rows.append((part, len(rows), name, out.n_docs, out.n_ids))

        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, ids in encoded(enc, batch.column(1), end_id):
                if out is None:
                    name = f"{url}/ids-{part:06d}-{len(rows):04d}.bin"
                    out = IdFileWriter(name, bits_for(enc.vocab), f"{task.taskAttemptId()}.tmp")
                out.add(names[row], ids)
                if out.n_ids >= shard_ids or out.n_docs >= shard_docs:
                    done()
                    out = None
        if out is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "shard", "url", "n_docs", "n_ids"])

    return written(dealt.mapInArrow(run, "part int, shard int, url string, n_docs long, n_ids long"), "id-manifest")


def read_id_files(manifest: DataFrame) -> DataFrame:
    """Digest of every document in the files of a manifest: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all files.  The
    running sum is over one row per file, not per document.
    """
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    spread = placed.select("url", "base").repartition(F.col("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = IdFile(url)
                digests = ((doc, base + at, len(ids), zlib.crc32(np.ascontiguousarray(ids).view(np.uint8))) for doc, at, ids in file.documents())
                while rows := list(islice(digests, BATCH_DOCS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                file.close()

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **columns) -> DataFrame:
    """Write ``docs`` to a new folder in the shared folder and read the files back.

    One row per document, repeated and null ones included (see
    ``write_id_files``); an empty table gives no row.
    """
    url = new_dir(docs.sparkSession, "token-ids")
    return read_id_files(write_id_files(docs, url, tokenizer_path, end_id, **columns))
