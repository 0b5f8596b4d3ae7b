"""Prefix trie of conversations: which openings are shared, and what sharing saves.

A conversation's path is the row of its turns' digests.  Paths are dealt to
shards by splitters and sorted there.  A node is a prefix of paths: either no
splitter runs through it, then one shard holds all its members and finishes it
in one pass over sorted rows; or it belongs to the skeleton, the trie of the
splitters' own prefixes, which every task knows, and the shards' partial
aggregates of it are reduced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import written

#: Bytes of a turn's digest.
DIGEST = 16

#: Turns that a shard holds about, shards at most, and sampled paths for each splitter: they balance the work only.
SHARD_TURNS, MOST_SHARDS, SAMPLES = 20_000, 10_000, 16

#: Rows of an output batch.
BATCH_ROWS = 8_192

NO_ENDS = hashlib.sha256(b"").hexdigest()

_PARTS = "kind int, skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string"
_NODE, _BELOW, _PARTIAL, _END = range(4)


def digest(role: str = "role", text: str = "text") -> Column:
    """Digest of a turn; null role and text count as empty."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, 2 * DIGEST))


def conversations(turns: DataFrame, *kept: Column) -> DataFrame:
    """One row per conversation: conv_id and ``path``, the ``kept`` columns of its turns in order of turn, null first.

    Turns of equal number follow their digests, so that a result never depends
    on the order of rows.  Rows without conv_id belong to no conversation.
    """
    one = F.struct(F.col("turn"), digest().alias("_digest"), F.struct(*kept).alias("_kept"))
    rows = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("path"))
    return rows.select("conv_id", F.col("path._kept").alias("path"))


def rebuilt(convs: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that open with the first turns of their group's first one.

    Conversation c takes the first h turns of c - c % ``group``, where h is the
    CRC-32 of its decimal id modulo ``heads``, and its own turns after the first h.
    An absent first one gives no turns; what remains may be a path without turns.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    first = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("path", 1, max(heads - 1, 1)).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    rows = convs.withColumn("_base", base).withColumn("_h", h).join(first, "_base", "left")
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("path", 1, 0))
    own = F.slice("path", F.col("_h") + 1, F.greatest(F.size("path") - F.col("_h"), F.lit(0)))
    return rows.select("conv_id", F.concat(head, own).alias("path"))


def keyed(convs: DataFrame) -> DataFrame:
    """Paths of (digest, chars) as one binary key, whose order is that of the trie, and a list of chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(1)
            flat, ends = path.flatten(), path.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            joined = b"".join(flat.field(0).to_numpy(zero_copy_only=False).tolist())
            keys = [joined[a * DIGEST : b * DIGEST] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.field(1))], ["conv_id", "key", "chars"])

    return convs.mapInArrow(run, "conv_id long, key binary, chars array<int>")


def common_turns(a: bytes, b: bytes) -> int:
    """Number of leading digests that two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST  # they share low digests, but not high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid)
    return low


def splitters(sample: list[tuple[bytes, int]], shards: int) -> list[tuple[bytes, int]]:
    """Up to ``shards`` - 1 bounds between shards, from a sample of (key, conv_id).

    A bound is the shortest prefix that parts its path from the one before it
    in the sample.  Among copies of one path it is the path with a conv_id, so
    that any number of copies is dealt to as many shards as it needs.
    """
    sample = sorted(sample)
    weight = np.cumsum([len(k) // DIGEST + 1 for k, _ in sample])
    out = []
    for at in np.unique(np.searchsorted(weight, weight[-1] * np.arange(1, shards) / shards)) if sample else []:
        key, conv = sample[at]
        before = sample[at - 1][0] if at else b""
        out.append((key, conv) if before == key else (key[: (common_turns(before, key) + 1) * DIGEST], -(1 << 63)))
    return sorted(set(out))


class Skeleton:
    """Trie of the prefixes that splitters run through; node 0 is the root, and parents come before children."""

    def __init__(self, bounds: list[tuple[bytes, int]]):
        self.parent, self.depth, self.child = [-1], [0], {}
        for key, conv in bounds:
            whole = conv != -(1 << 63)  # a bound by conv_id parts the members of its path, any other one stands before its path
            at = 0
            for k in range(0, len(key) - (not whole) * DIGEST, DIGEST):
                step = (at, key[k : k + DIGEST])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[step]


class _Open:
    """A node whose members are being read."""

    __slots__ = ("skeleton", "chars", "least", "n", "children", "leaves", "saved", "ends", "pending")

    def __init__(self, skeleton: int, chars: int):
        self.skeleton, self.chars = skeleton, chars
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.pending = None, []


class Shard:
    """Reads the sorted paths of a shard and makes rows of ``_PARTS``."""

    def __init__(self, skeleton: Skeleton):
        self.child, self.rows = skeleton.child, []
        self.open, self.key = [_Open(0, 0)], b""

    def add(self, key: bytes, chars: list[int], conv: int) -> None:
        shared = common_turns(self.key, key)
        while len(self.open) > shared + 1:
            self.close()
        for d in range(shared, len(key) // DIGEST):
            at = self.open[-1].skeleton
            self.open.append(_Open(self.child.get((at, key[d * DIGEST : (d + 1) * DIGEST]), -1) if at >= 0 else -1, chars[d]))
        self.key, node = key, self.open[-1]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if node.skeleton >= 0:
            self.rows.append((_END, node.skeleton, conv, *[None] * 8))
        elif node.ends is None:
            node.ends = hashlib.sha256(b"%d" % conv)
        else:
            node.ends.update(b",%d" % conv)

    def close(self) -> None:
        node, depth = self.open.pop(), len(self.open)
        up = self.open[-1] if self.open else None
        if node.skeleton >= 0:
            if node.n:
                self.rows.append((_PARTIAL, node.skeleton, node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.chars, None))
        else:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.chars
            up.children += 1
            row = (node.n, node.children, node.leaves, node.saved, node.chars, node.ends.hexdigest() if node.ends else NO_ENDS)
            if up.skeleton >= 0:
                self.rows.append((_BELOW, up.skeleton, node.least, depth, None, *row))
            else:
                up.pending.append((node.least, depth, row))
            self.rows += [(_NODE, None, least, deep, node.least, *more) for least, deep, more in node.pending]
        if up is not None and node.n:
            up.n += node.n
            up.leaves += node.leaves
            up.saved += node.saved
            up.least = node.least if up.least is None else min(up.least, node.least)

    def end(self) -> None:
        while self.open:
            self.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 8, pa.string()]
    names = [f.split()[0] for f in _PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def shard_rows(sharded: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Nodes and partial aggregates of shards; partitions are sorted by shard, key and conv_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        for batch in batches:
            for s, key, chars, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    kept = now.rows if now else []
                    if now:
                        now.end()
                    shard, now = s, Shard(skeleton)
                    now.rows = kept
                now.add(key, chars, conv)
                if len(now.rows) >= BATCH_ROWS:
                    yield _batch(now.rows)
                    now.rows = []
        if now:
            now.end()
            for at in range(0, len(now.rows), BATCH_ROWS):
                yield _batch(now.rows[at : at + BATCH_ROWS])

    return sharded.select("shard", "key", "chars", "conv_id").mapInArrow(run, _PARTS)


def ends_of(ends: DataFrame, tasks: int) -> DataFrame:
    """(skeleton, ends_sha256): digest of the sorted conv_ids of each skeleton node, as a stream over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text, out = None, None, []
        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != at:
                    if text:
                        out.append((at, text.hexdigest()))
                    at, text = node, hashlib.sha256(b"%d" % conv)
                else:
                    text.update(b",%d" % conv)
        if text:
            out.append((at, text.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out])], ["skeleton", "ends_sha256"])

    return ends.repartition(tasks, "skeleton").sortWithinPartitions("skeleton", "conv_id").mapInArrow(run, "skeleton int, ends_sha256 string")


def finished(skeleton: Skeleton, parts: list) -> list[tuple]:
    """Rows of the skeleton's nodes from their reduced partial aggregates: their own share is added from the deepest up."""
    got = {r["skeleton"]: r for r in parts}
    n = len(skeleton.parent)
    children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), [0] * n
    for k in range(n - 1, -1, -1):
        r = got.get(k)
        if r is None:
            continue
        children[k] += r["n_children"]
        leaves[k] += children[k] == 0
        saved[k] += (r["n_convs"] - 1) * r["chars"]
        if k:
            up = skeleton.parent[k]
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
    return [(k, r["conv_id"], skeleton.depth[k], got[skeleton.parent[k]]["conv_id"] if k else None, r["n_convs"], int(children[k]), int(leaves[k]) + r["n_leaves"], saved[k] + r["saved_tokens"]) for k, r in sorted(got.items())]


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of ``convs`` (conv_id, path of (digest, chars)), one row each.

    Returns conv_id (the smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves (childless nodes in the subtree),
    saved_tokens (over the subtree, members beyond the first times ``chars``)
    and ends_sha256 (of the members that end here, in order, comma-joined).
    Paths without turns end at the root; copies of a path share its nodes; no
    conversation gives no row.  conv_ids are distinct.

    A row holds one conversation's digests, 20 bytes a turn; texts are not moved.
    The driver gets ``SAMPLES`` paths for each shard and the skeleton, at most
    the shards times a path's length.  Copies are dealt by conv_id, and all
    sums are partial, but the digest of ends is a sequential hash by definition:
    those of a skeleton node are one task's sorted stream, with no state but the hash.
    """
    spark = convs.sparkSession
    paths = written(keyed(convs), "paths")
    n, turns = paths.agg(F.count("*"), F.coalesce(F.sum(F.size("chars")), F.lit(0))).first()
    shards = min(MOST_SHARDS, 1 + (n + turns) // shard_turns)
    every = max(1, n // (SAMPLES * shards))
    sample = [(bytes(r["key"]), r["conv_id"]) for r in paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("key", "conv_id").collect()] if shards > 1 else []
    bounds = splitters(sample, shards)
    skeleton = Skeleton(bounds)

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect_right(bounds, at) for at in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "shard"])

    dealt = paths.mapInArrow(shard_of, "conv_id long, key binary, chars array<int>, shard int")
    sharded = dealt.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "key", "conv_id")
    rows = written(shard_rows(sharded, skeleton), "trie-parts")
    sums = [F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("chars").alias("chars")]
    top = finished(skeleton, rows.filter(F.col("kind") == _PARTIAL).groupBy("skeleton").agg(*sums).collect())
    head = spark.createDataFrame(top, "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = ends_of(rows.filter(F.col("kind") == _END).select("skeleton", "conv_id"), max(1, min(len(bounds) + 1, len(top))))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    least = head.select("skeleton", F.col("conv_id").alias("_parent"))
    below = rows.filter(F.col("kind") == _BELOW).drop("parent_conv_id").join(least, "skeleton").withColumnRenamed("_parent", "parent_conv_id")
    whole = head.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return rows.filter(F.col("kind") == _NODE).select(out).unionByName(below.select(out)).unionByName(whole.select(out))


def shared_openings(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Trie of rebuilt conversations of ``turns`` (conv_id, turn, role, text); see ``rebuilt`` and ``prefix_trie``.

    Null roles and texts are empty ones and a turn of its own; repeated rows are
    repeated turns; other columns are not read; chars are code points.
    """
    chars = F.coalesce(F.length("text"), F.lit(0)).alias("chars")
    return prefix_trie(rebuilt(conversations(turns, digest().alias("digest"), chars), group, heads))


def with_turns(nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes with the last turn of each, from ``convs`` whose paths hold what is wanted (role and text, say); null at the root."""
    paths = convs.select("conv_id", F.col("path").alias("_path"))
    return nodes.join(paths, "conv_id", "left").withColumn("turn", F.when(F.col("depth") > 0, F.try_element_at("_path", F.col("depth").cast("int")))).drop("_path")


def shared_openings_sql(group: int = 100, heads: int = 6) -> str:
    """The rows of ``shared_openings`` in SQL: every member of every node is joined to it."""
    return f"""
WITH own AS (SELECT conv_id, length(coalesce(text, '')) AS chars, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS mark, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS pos FROM own),
ids AS (SELECT conv_id, conv_id - conv_id % {group} AS base, xor(list_reduce(list_concat([4294967295::BIGINT],
        flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], list_resize([]::BIGINT[], 8, (-1)::BIGINT))))),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295) % {heads} AS h FROM (SELECT DISTINCT conv_id FROM own)),
bases AS (SELECT i.conv_id, i.h, count(p.pos) AS heads FROM ids i LEFT JOIN placed p ON p.conv_id = i.base AND p.pos <= i.h GROUP BY ALL),
turns AS (SELECT i.conv_id, p.pos, p.mark, p.chars FROM ids i JOIN placed p ON p.conv_id = i.base AND p.pos <= i.h
    UNION ALL SELECT b.conv_id, p.pos - b.h + b.heads, p.mark, p.chars FROM bases b JOIN placed p ON p.conv_id = b.conv_id AND p.pos > b.h),
steps AS (SELECT conv_id, pos AS depth, chars, sha256(string_agg(mark, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM turns
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM steps GROUP BY node, depth),
parents AS (SELECT n.*, p.node AS up, m.conv_id AS parent_conv_id FROM nodes n LEFT JOIN steps p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes m ON m.node = p.node AND m.depth = p.depth),
counted AS (SELECT a.*, coalesce(k.n, 0) AS n_children FROM parents a LEFT JOIN (SELECT up, count(*) AS n FROM parents WHERE up IS NOT NULL GROUP BY up) k ON k.up = a.node),
below AS (SELECT s.node, sum((c.n_children = 0)::INT) AS n_leaves, sum((c.n_convs - 1) * c.chars) AS saved FROM counted c JOIN steps s ON s.conv_id = c.conv_id AND s.depth <= c.depth GROUP BY s.node),
tips AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, node FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY node)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs, c.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(t.ids, '')) AS ends_sha256
FROM counted c JOIN below b ON b.node = c.node LEFT JOIN tips t ON t.node = c.node"""
