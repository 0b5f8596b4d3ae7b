"""Hard negatives for contrastive training, by the threshold algorithm.

Candidate rows are dealt to chunks.  In a task each component of a chunk is a
sorted list; an anchor reads every list from the end that its own component's
sign favours, scores the rows it meets for the first time in whole numbers, and
stops once no unread row can still enter any of its windows.  The best rows of
all chunks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.llm.common import written

#: Candidate rows and anchors that meet in one task at a time, about.
CHUNK_ROWS, BLOCK_ANCHORS = 8_192, 2_048

#: Entries of each list that are read at first; every further step reads as many as were read before.
FIRST_STEP = 16

#: Scaled components stay below this size, so that scores of up to 16,384 components fit a long.
LARGEST = 1 << 24

_FOUND = "anchor_id long, akey long, positive_score long, other_id long, score long"


def usable(vectors: DataFrame, scale: int, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """vec_id, label and whole-number components ``q`` of the rows that take part, and ``akey``, a hash of all three."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < LARGEST))
    rows = vectors.filter(F.col(label_col).isNotNull() & x.isNotNull() & fine)
    out = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("q"))
    return out.withColumn("akey", F.xxhash64("vec_id", "label", "q"))


def padded(q: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, short ones filled up with zeros."""
    n = np.diff(q.offsets.to_numpy())
    out = np.zeros((len(q), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = q.flatten().to_numpy()
    return out


def best(score: np.ndarray, null: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; ties go by id, null last."""
    some = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
    return some[np.lexsort((ids[some], null[some], -score[some]))[:k]]


class Lists:
    """A chunk's rows, and for each component its rows in ascending order."""

    def __init__(self, rows: pa.Table, dims: int, reach: int):
        self.q = padded(rows["q"].combine_chunks(), dims)
        ids = rows["vec_id"].combine_chunks()
        self.null, self.ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        self.label = rows["label"].combine_chunks().dictionary_encode()
        self.order = np.argsort(self.q, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.q, self.order, axis=0)
        most = int(np.abs(self.q).max(initial=0)) * reach * max(dims, 1)
        #: Floating-point numbers hold every sum exactly below these sizes.
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        self.exact = self.q.astype(self.kind)

    def scan(self, anchor: np.ndarray, fits: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the places and scores of the ``k`` best rows in it that ``fits`` marks."""
        n = len(self.q)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        weight, seen = anchor.astype(self.kind), np.zeros(n, bool)
        got = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(windows)
        depth, step = 0, FIRST_STEP
        while depth < n:
            end = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[n - end : n - depth, up]] = True
            met[self.order[depth:end, down]] = True
            if not len(up) + len(down):  # all scores are 0: there is no list to read, only rows
                met[depth:end] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            new = new[fits[new]]
            score = (self.exact[new] @ weight).astype(np.int64)
            bound = int(self.sorted[n - end, up] @ anchor[up] + self.sorted[end - 1, down] @ anchor[down])
            done = end == n
            if not done:
                done = True
            for w, (low, high) in enumerate(windows):
                inside = (score >= low) & (score <= high)
                at, had = np.concatenate([got[w][0], new[inside]]), np.concatenate([got[w][1], score[inside]])
                top = best(had, self.null[at], self.ids[at], k)
                got[w] = at[top], had[top]
                done &= bound < low or (len(top) == k and bound < had[top[-1]])
            if done:
                break
            depth, step = end, end
        return got


def first_of_equal(rows: pa.Table) -> pa.Table:
    """Rows without repetitions of the same id, label and components."""
    if len(rows) == len(rows["akey"].unique()):
        return rows
    keys = list(zip(rows["vec_id"].to_pylist(), rows["label"].to_pylist(), map(tuple, rows["q"].to_pylist()), strict=True))
    return rows.take(pa.array(list({key: at for at, key in reversed(list(enumerate(keys)))}.values())))


def scanned(rows: pa.Table, anchors: pa.Table, shares: tuple[int, int] | None, k: int) -> Iterator[tuple]:
    """Rows of ``_FOUND``: what each anchor finds among a chunk's rows.

    With ``shares`` (low, high) these are rows of other labels between these
    percentages of its positives' scores, else rows of its own label.
    """
    rows = first_of_equal(rows)
    dims = max(int(np.diff(t["q"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (rows, anchors))
    a = padded(anchors["q"].combine_chunks(), dims)
    lists = Lists(rows, dims, int(np.abs(a).max(initial=0)))
    codes, names = lists.label.indices.to_numpy(), {v: c for c, v in enumerate(lists.label.dictionary.to_pylist())}
    ends = np.iinfo(np.int64)
    for at, (anchor, akey, label) in enumerate(zip(*(anchors[c].to_pylist() for c in ("vec_id", "akey", "label")), strict=True)):
        same = codes == names.get(label, -1)
        positives = anchors["positives"][at].as_py() if shares else [0]
        windows = [(-(-shares[0] * p // 100), shares[1] * p // 100) for p in positives] if shares else [(ends.min, ends.max)]
        found = lists.scan(a[at], (~same if shares else same) & (lists.null | (lists.ids != anchor)), windows, k)
        for positive, (places, scores) in zip(positives, found, strict=True):
            for p, s in zip(places.tolist(), scores.tolist(), strict=True):
                yield anchor, akey, positive, None if lists.null[p] else int(lists.ids[p]), s


def met(rows: DataFrame, anchors: DataFrame, keys: list[str], shares: tuple[int, int] | None, k: int) -> DataFrame:
    """The ``k`` best of what the anchors find among the rows that meet them under equal ``keys``, with ``rank``.

    Tasks return ``k`` rows for each anchor, window and chunk.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(scanned(left, right, shares, k)) if len(left) and len(right) else []
        columns = zip(*found, strict=True) if found else [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in _FOUND.split(", ")])

    found = rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(run, _FOUND)
    order = Window.partitionBy("anchor_id", "akey", "positive_score").orderBy(F.desc("score"), F.col("other_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dealt(df: DataFrame, own: str, owns: Column, other: str, others: Column) -> DataFrame:
    """Each row in its own of ``owns`` parts, once for every one of ``others`` parts of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64("akey"), owns).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), others - 1)))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Negatives that score nearly as high as each positive of an anchor.

    Anchors are the rows whose id is divisible by ``every``.  Components become
    floor(``scale`` * x); a score is the inner product with the anchor; higher
    ones come first, ties by smaller id, null last.  An anchor's positives are
    its ``positives`` best other rows of its label.  For each one, the
    ``negatives`` best rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score are returned: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label or vector, or a null, NaN, infinite or overlong
    component (``LARGEST``, scaled) take no part; short vectors count as filled
    up with zeros.  Rows repeated in id, label and components count once; rows
    that share an anchor's id are not its others.  An anchor without positives,
    a positive without such negatives and an empty table give no row.  Other
    columns are not read.

    Positives are sought in chunks of the anchor's label only, negatives in
    chunks of all rows; a chunk meets the anchors block by block, so a task
    holds ``CHUNK_ROWS`` rows and ``BLOCK_ANCHORS`` anchors whatever the sizes.
    """
    rows = written(usable(vectors, scale, id_col, label_col, vec_col), "vectors")
    is_anchor = F.col("vec_id") % every == 0
    anchors = written(rows.filter(is_anchor).dropDuplicates(["vec_id", "label", "q"]), "anchors")

    def parts(n: Column, size: int) -> Column:
        return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")

    sizes = written(rows.groupBy("label").agg(parts(F.count("*"), CHUNK_ROWS).alias("chunks"), parts(F.count_if(is_anchor), BLOCK_ANCHORS).alias("blocks")), "labels")
    left = dealt(rows.join(sizes, "label"), "chunk", F.col("chunks"), "block", F.col("blocks")).drop("chunks", "blocks")
    right = dealt(anchors.join(sizes, "label"), "block", F.col("blocks"), "chunk", F.col("chunks")).drop("chunks", "blocks")
    found = met(left, right, ["label", "chunk", "block"], None, positives)
    found = written(found.select("anchor_id", "akey", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = found.groupBy(F.col("anchor_id").alias("vec_id"), "akey").agg(F.collect_set("positive_score").alias("positives"))
    chunks, blocks = (F.lit(max(1, -(-df.count() // size))) for df, size in ((rows, CHUNK_ROWS), (anchors, BLOCK_ANCHORS)))
    left = dealt(rows, "chunk", chunks, "block", blocks)
    right = dealt(anchors.join(windows, ["vec_id", "akey"]), "block", blocks, "chunk", chunks)
    negs = met(left, right, ["chunk", "block"], (low, high), negatives)
    return found.join(negs, ["anchor_id", "akey", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives_sql() -> str:
    """The rows of ``hard_negatives`` with its default numbers in SQL, for vectors of one length: every anchor is scored with every row."""
    return f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(256 * x::DOUBLE) >= {LARGEST})) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON b.vec_id IS DISTINCT FROM a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id NULLS LAST)::INT AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score QUALIFY rank <= 5"""
