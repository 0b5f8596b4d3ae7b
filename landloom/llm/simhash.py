"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.llm.common import fresh_name, text_chunks, with_columns_of, written
from landloom.llm.components import connected_components

BITS = 64
#: Most fingerprints of one bucket that are compared pair by pair.
BUCKET_ROWS = 512
#: Numbers of parts that the plan chooses among.
PARTS = (2, 3)
_STEP_BYTES = 2 << 20


def fingerprints_of(text: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text, as signed 64-bit integers.

    A-Z are lower-cased; shingles are ``shingle`` words joined by spaces, the
    whole sequence if there are fewer; a bit is set if it is set in over half
    of the shingles' hashes; a text without words gets 0.
    """
    out, digest = np.zeros(len(text), np.int64), xxhash.xxh64_digest
    for row, part in text_chunks(text, _STEP_BYTES):
        hashes, counts = [], []
        for t in part.to_numpy(zero_copy_only=False).tolist():
            words = t.encode("utf-8", "surrogatepass").lower().split()
            n = max(1, len(words) - shingle + 1) if words else 0
            counts.append(n)
            if n == 1:
                hashes.append(digest(b" ".join(words), seed))
            elif n:
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
                hashes += [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        counts = np.array(counts)
        full = np.flatnonzero(counts)
        if len(full):
            bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
            first = np.cumsum(counts[full]) - counts[full]
            ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            out[row + full] = np.packbits(2 * ones > counts[full][:, None], axis=1).view(">i8").reshape(-1)
    return out


def fingerprinted(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of its text as a last, long column."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints_of(batch.column(at)))], [*batch.schema.names, name])

    return docs.mapInArrow(run, with_columns_of(docs.schema, [(name, T.LongType())]))


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bit i and bit j set (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])

    got = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for r in got:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of like size, each grown by its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    """The bits (0 is the highest) as a signed 64-bit mask."""
    m = sum(1 << (BITS - 1 - b) for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost, by dynamic programming over the parts.

    ``costs[i][t + 1]`` is that of threshold t, from -1 (part not used) to
    ``distance``.  The thresholds add up to distance - parts + 1: two
    fingerprints within ``distance`` then are within the threshold of one part.
    """
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, c in enumerate(cost, start=-1):
                if total + t not in step or spent + c < step[total + t][0]:
                    step[total + t] = (spent + c, [*chosen, t])
        best = step
    return best[distance - len(costs) + 1]


def plan_parts(nodes: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds that promise the fewest candidates.

    Candidates within threshold 0 are counted: the sum of squares of the sizes
    of a part's buckets.  Each further bit multiplies them by the odds that
    bits of the part differ; probes count as well.
    """
    n, both = bit_counts(nodes)
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    choices = {m: correlated_parts(n, both, m) for m in PARTS}
    groups = [g for m in PARTS for g in choices[m]]
    keys = F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("key")) for k, g in enumerate(groups)))
    sizes = nodes.select(F.explode(keys).alias("k")).groupBy("k").count().groupBy("k.part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
    pairs = {r["part"]: r["pairs"] for r in sizes.collect()}  # one row per part
    best, at = None, 0
    for m in PARTS:
        costs = []
        for g in choices[m]:
            row, grown, probes = [0.0], 1.0, 1
            for t in range(distance + 1):
                if t:
                    grown += sum(np.prod(odds[list(c)]) for c in combinations(g, t))
                    probes += len(list(combinations(g, t)))
                row.append(pairs.get(at, 0.0) * grown + n * probes)
            costs.append(row)
            at += 1
        cost, thresholds = allocate(costs, distance)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(choices[m], thresholds, strict=True) if t >= 0])
    return best[1]


def flips(bits: list[int], most: int) -> list[int]:
    """Masks of up to ``most`` of the bits."""
    return [mask_of(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


def links(nodes: DataFrame, distance: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) that link all fingerprints within ``distance``, here 2.

    Every fingerprint is indexed by its bits in each part and probes the values
    within the part's threshold.  Buckets of up to ``bucket_rows`` fingerprints
    are joined and each candidate verified.  Fingerprints in or around a fuller
    bucket go another, exact way: each emits the values within one bit of it,
    two at distance 2 or less share one, any two that share one are that close,
    and at most 65 can.  So no bucket is cut and none is compared in squares.
    """
    if distance != 2:
        raise ValueError("the way for full buckets is made for a distance of 2")
    rows = []
    for k, (bits, t) in enumerate(plan_parts(nodes, distance)):
        home = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        probes = F.array(*(home.bitwiseXOR(F.lit(m)) for m in flips(bits, t)))
        rows.append(nodes.select("fp", F.lit(k).alias("part"), home.alias("home"), F.explode(probes).alias("key")))
    rows = reduce(DataFrame.unionByName, rows)
    full = written(rows.filter("key = home").groupBy("part", "key").count().filter(F.col("count") > bucket_rows).select("part", "key"), "full-buckets")
    thin = rows.join(full, ["part", "key"], "left_anti").join(full.withColumnRenamed("key", "home"), ["part", "home"], "left_anti")
    indexed = thin.filter("key = home").select("part", "key", F.col("fp").alias("u"))
    found = indexed.join(thin.select("part", "key", F.col("fp").alias("v")), ["part", "key"]).filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")
    dense = rows.join(full, ["part", "key"], "left_semi").select("fp").distinct()
    near = F.array(*(F.col("fp").bitwiseXOR(F.lit(m)) for m in flips(list(range(BITS)), 1)))
    shared = dense.select("fp", F.explode(near).alias("middle")).groupBy("middle").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = shared.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v")
    return found.unionByName(stars)


def roots_of(docs: DataFrame, distance: int) -> DataFrame:
    """(fp, least, root) of every fingerprint: its least doc_id, and the least fingerprint that links reach."""
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(links(nodes, distance))
    return written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")


def component_of(docs: DataFrame, distance: int = 2) -> DataFrame:
    """(fp, component_id) of every fingerprint in ``docs`` (doc_id, fp).

    Equal fingerprints are one node.  component_id is the least doc_id that a
    chain of links reaches; null if all of them are null.
    """
    rooted = roots_of(docs, distance)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    return written(rooted.join(least, F.col("root").bitwiseXOR(F.lit(1)) == F.col("r").bitwiseXOR(F.lit(1))).select("fp", "component_id"), "components")


def near_duplicates(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document: doc_id, fingerprint, component_id.

    Documents link if their fingerprints differ in at most ``distance`` bits.
    Null texts and texts without words have the fingerprint zero; repeated rows
    stay; an empty table gives no row; other columns are not read.
    """
    marked = written(fingerprinted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text").select("doc_id", "fp"), "simhash")
    out = marked.join(component_of(marked, distance), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: that with the least id of each component.

    If rows repeat that id, the one with the least hash of its text stays.
    Null and empty texts are one group, texts of any length are hashed whole,
    null ids come last, all columns stay as they are and an empty table gives
    no row.
    """
    fp, key, h = (fresh_name(docs.columns, c) for c in ("fp", "key", "hash"))
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("string"), F.lit("")), h: F.xxhash64(text_col)})
    marked = written(fingerprinted(keyed, text_col, fp), "simhash-rows", "zstd")
    narrow = marked.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp"), F.col(key).alias("_k"), F.col(h).alias("_h"))
    parts = roots_of(narrow, distance)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h", "_k"))
    best = narrow.join(parts, "fp").groupBy("root").agg(first.alias("x")).select(F.col("x._k").alias(key), F.col("x._h").alias(h))
    # the texts are shuffled once: rows that repeat a key lie together after the join
    return marked.join(best, [key, h], "left_semi").dropDuplicates([key, h]).select(*docs.columns)
