"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c.  After a rotation to
principal axes they are cut into blocks, each with a share of that distance in
proportion to its variance; two near vectors are within the share of one block
at least.  Each block is range-joined: vectors are dealt to cells of two of the
block's axes and visit the cells behind theirs that lie within the share.  Full
cells are dealt again on the block's next two axes.  Inside a cell the rows are
swept along slabs one reach wide, so that few pairs beyond the share are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import written
from landloom.llm.components import connected_components

#: Axes of a block, and the most blocks: a vector goes to each, so more axes make wider blocks.
BLOCK_DIMS, MOST_BLOCKS = 8, 8
#: Components that are rotated; distances in these are no larger than in all, so the search stays whole, and what meets is checked on all.
MOST_DIMS = 1_024
#: Vectors of a cell that one task holds; fuller cells are dealt on more axes, and at the last ones to pairs of chunks.
CHUNK_ROWS = 2_048
#: Width of a cell in reaches of its block.
CELL_REACHES = 4.0
#: Axes of a block that cells are cut on at a time, and the offsets from a cell to the cells behind it.
CELL_AXES = 2
#: How often full cells are cut before they are dealt to pairs of chunks.
CELL_LEVELS = 4
BEHIND = ((0, 1), (1, -1), (1, 0), (1, 1))
#: Axes on which the rows of a cell are cut into slabs, before the one they are swept on.
SLAB_AXES = 5
#: Pairs that one vectorised step looks at.
PAIRS_AT_ONCE = 1 << 18
#: Axes of a block by which pairs are left out at a time, and numbers that a step of the rotation holds.
AXES_AT_ONCE, ROTATED_AT_ONCE = 16, 1 << 15
_SLACK = 1e-9


def moments(vectors: DataFrame, dims: int) -> np.ndarray:
    """Second moments of the first ``dims`` components of column ``unit`` (dims x dims), summed over all rows.

    Each task sums its rows; the sums are added line by line, so the driver gets
    ``dims`` arrays, at most ``MOST_DIMS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = padded(batch.column(0), dims)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), lists_of(total)], ["line", "s"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(padded(batch.column(1), dims).sum(axis=0) for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), lists_of(total[None])], ["line", "s"])

    lines = vectors.select("unit").mapInArrow(run, "line long, s array<double>").groupBy("line").applyInArrow(add, "line long, s array<double>")
    out = np.zeros((dims, dims))
    for r in lines.toLocalIterator():
        out[r["line"]] = r["s"]
    return out


def lists_of(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def padded(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of ``dims`` doubles, zeros behind short ones; what long ones have beyond is left out."""
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(n, dims)
    out = np.zeros((n, dims))
    row, place = np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = place < dims
    out[row[held], place[held]] = flat[held]
    return out


def rotated(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """x @ axes in an order of additions that doesn't depend on the number of rows."""
    out = np.zeros_like(x)
    step = max(1, ROTATED_AT_ONCE // max(1, x.shape[1]))
    for at in range(0, len(x), step):
        some, turned = x[at : at + step], out[at : at + step]
        for k in range(x.shape[1]):
            turned += some[:, k : k + 1] * axes[k]
    return out


class Subspaces:
    """Axes, blocks and each block's share of the squared distance."""

    def __init__(self, second: np.ndarray, distance2: float, block_dims: int):
        dims = len(second)
        values, axes = np.linalg.eigh(second)
        order = np.argsort(-values, kind="stable")
        self.axes, variance = axes[:, order], np.maximum(values[order], 0) + 1e-6 * max(values.sum(), 1e-300)
        n = min(-(-dims // block_dims), MOST_BLOCKS)
        # the widest axes go to different blocks, so that each block has some to cut cells on
        self.blocks = [list(range(b, dims, n)) for b in range(n)]
        share = np.array([variance[b].sum() for b in self.blocks])
        self.budget = (distance2 + _SLACK) * share / share.sum() + 1e-12
        self.reach = np.sqrt(self.budget)

    def squares(self, gap: np.ndarray) -> np.ndarray:
        """Squared length of each row of gaps in each block."""
        return np.stack([(gap[:, b] ** 2).sum(axis=1) for b in self.blocks], axis=1)


def dealt(rows: DataFrame, spaces: Subspaces, dims: int, level: int) -> DataFrame:
    """Rows again for each cell of the ``level``-th axes of their blocks that they are in or visit.

    At level 0 rows are (node, grp, times, unit) and go to all blocks; later
    they have a block, their place in it, and a path of cells that grows.  Bit ``level`` of
    ``visits`` marks visitors: a pair counts where no bit is common, so that
    each pair within reach meets in one cell of a block.
    """

    wide = max(map(len, spaces.blocks))

    def cells(place: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        axes, width = range(len(spaces.blocks[block]))[level * CELL_AXES : (level + 1) * CELL_AXES], CELL_REACHES * spaces.reach[block]
        x = np.zeros((len(place), CELL_AXES))
        x[:, : len(axes)] = place[:, axes]
        home = np.floor(x / width).astype(np.int64)
        yield np.arange(len(place)), home, 0
        below = x - home * width
        for step in BEHIND if len(axes) == CELL_AXES else ((1, 0),) * len(axes):
            gap = np.where(np.array(step) > 0, width - below, np.where(np.array(step) < 0, below, 0.0))
            at = np.flatnonzero((gap**2).sum(axis=1) <= spaces.budget[block])
            yield at, home[at] + step, 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            y = padded(named["place"], wide) if level else rotated(padded(named["unit"], dims), spaces.axes)
            of = named["block"].to_numpy() if level else None
            found, places = [], []
            for block, axes in enumerate(spaces.blocks):
                mine = np.flatnonzero(of == block) if level else np.arange(len(y))
                place = y[mine][:, : len(axes)] if level else y[:, axes]
                for at, cell, bit in cells(place, block):
                    places.append(lists_of(place[at]))
                    found.append((mine[at], np.full(len(at), block), cell[:, 0], cell[:, 1], np.full(len(at), bit)))
            at, block, first, second, bit = (np.concatenate(c) for c in zip(*found, strict=True))
            take = pa.array(at)
            if level:
                bit = bit | named["visits"].to_numpy()[at]
                path = named["path"].take(take)
            else:
                path = pa.nulls(len(at), pa.string())
            kept = [named[c].take(take) for c in ("node", "grp", "times", "unit")]
            yield pa.RecordBatch.from_arrays([*kept, pa.concat_arrays(places), pa.array(block), pa.array(bit), path, pa.array(first), pa.array(second)], [*"node grp times unit place block visits path first second".split()])

    out = rows.mapInArrow(run, "node long, grp string, times long, unit array<double>, place array<double>, block long, visits long, path string, first long, second long")
    return out.select("node", "grp", "times", "unit", "place", "block", "visits", F.concat_ws("/", "path", F.concat_ws(",", "first", "second")).alias("path"))


def met(classes: DataFrame, spaces: Subspaces, dims: int, chunk_rows: int) -> DataFrame:
    """Rows of ``dealt`` by the cell in which they are compared, with chunk, low and high.

    Cells with more than ``chunk_rows`` rows go on to the next axes of their
    block.  Those that are as full on the last axes are dealt to pairs of chunks.
    """
    keys, parts = ["grp", "block", "path"], []
    levels = min(CELL_LEVELS, -(-max(map(len, spaces.blocks)) // CELL_AXES))
    rows = dealt(classes, spaces, dims, 0)
    for level in range(1, levels + 1):
        full = written(rows.groupBy(*keys).count().filter(F.col("count") > chunk_rows), "full-cells")
        if full.isEmpty():
            break
        parts.append(rows.join(full, keys, "left_anti"))
        rows = rows.join(full.withColumn("chunks", F.ceil(F.col("count") / chunk_rows).cast("int")).drop("count"), keys)
        if level < levels:
            rows = written(dealt(rows.drop("chunks"), spaces, dims, level), "cells")
    else:
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        parts.append(rows.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}).drop("chunks", "other"))
        rows = None
    whole = [p if "low" in p.columns else p.withColumns({c: F.lit(0) for c in ("chunk", "low", "high")}) for p in [*parts, *([] if rows is None else [rows])]]
    out = whole[0]
    for p in whole[1:]:
        out = out.unionByName(p)
    return out


def close_pairs(x: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows whose squared distance may be up to ``limit``, each pair once.

    Rows are sorted by their slabs, one reach wide, on the first axes and by
    their value on the next one; each row meets those of its own and of the
    adjoining slabs whose value is within reach.
    """
    n, reach = len(x), np.sqrt(limit)
    k = min(SLAB_AXES, x.shape[1] - 1)
    slab = np.floor(x[:, :k] / reach).astype(np.int64)
    slab -= slab.min(axis=0) - 1
    radix = np.cumprod(np.concatenate([[1], slab.max(axis=0)[:-1] + 2])) if k else np.empty(0, np.int64)
    cells, cell = np.unique(slab @ radix, return_inverse=True)
    value = x[:, k] - x[:, k].min()
    wide = value.max() + 4 * reach
    order = np.argsort(cell * wide + value, kind="stable")
    cell, value = cell[order], value[order]
    key = cell * wide + value
    reach *= 1 + 1e-6
    for step in product((-1, 0, 1), repeat=k):
        if step < (0,) * k:
            continue
        near = cells + np.array(step, np.int64) @ radix
        at = np.minimum(np.searchsorted(cells, near), len(cells) - 1)
        rows = np.flatnonzero((cells[at] == near)[cell])
        to = at[cell[rows]] * wide + value[rows]
        begin = np.searchsorted(key, to - reach) if any(step) else rows + 1
        each = np.maximum(np.searchsorted(key, to + reach, side="right") - begin, 0)
        ends = np.cumsum(each)
        done = 0
        while done < len(rows):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS_AT_ONCE, side="right")))
            m = each[done:stop]
            if total := int(m.sum()):
                yield order[np.repeat(rows[done:stop], m)], order[np.arange(total) + np.repeat(begin[done:stop] - (np.cumsum(m) - m), m)]
            done = stop


def links(classes: DataFrame, spaces: Subspaces, dims: int, cosine: float, chunk_rows: int) -> DataFrame:
    """Links counted and thinned in each task: (u, v, n).

    A row with v null says that u has links to n more vectors; the others are
    edges that span what is linked in the task.  A pair counts in the first
    block whose share it keeps, so in one task, however many blocks find it.
    """
    keys = ["block", "grp", "path", "low", "high"]
    rows = met(classes, spaces, dims, chunk_rows).repartition(*keys)  # else the chunks of a cell would stay in one task

    def named(u: np.ndarray | list, v: pa.Array | None, n: np.ndarray | list) -> pa.Table:
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.nulls(0, pa.int64()) if v is None else v, "n": pa.array(n, pa.int64())})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, across = key[0].as_py(), key[3] != key[4]
        units, places = table["unit"].combine_chunks(), table["place"].combine_chunks()
        x = padded(units, int(pc.max(pc.list_value_length(units)).as_py()))  # vectors of a group are of one length
        small, length = padded(places, len(spaces.blocks[block])), np.sqrt(np.einsum("ij,ij->i", x, x))
        chunk, times, node, visits = (table[c].to_numpy() for c in ("chunk", "times", "node", "visits"))
        n, left, right = len(x), [], []

        turned, known = np.zeros((n, dims)), np.zeros(n, bool)

        def turned_of(some: np.ndarray) -> np.ndarray:
            new = some[~known[some]]
            if len(new):
                turned[new] = rotated(padded(units.take(pa.array(new)), dims), spaces.axes)
                known[new] = True
            return turned[some]

        def keep(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
            p, q = (np.concatenate(c) for c in zip(*pairs, strict=True))
            step = max(1, PAIRS_AT_ONCE * 8 // x.shape[1])
            for at in range(0, len(p), step):
                check(p[at : at + step], q[at : at + step])

        def check(p: np.ndarray, q: np.ndarray) -> None:
            near = np.einsum("ij,ij->i", x[p], x[q]) / (length[p] * length[q]) >= cosine
            p, q = p[near], q[near]
            if len(p):
                some, place = np.unique(np.concatenate([p, q]), return_inverse=True)
                y = turned_of(some)
                over = spaces.squares(y[place[: len(p)]] - y[place[len(p) :]]) - spaces.budget
                inside = over <= 0
                inside[~inside.any(axis=1), over[~inside.any(axis=1)].argmin(axis=1)] = True
                mine = inside.argmax(axis=1) == block
                left.append(p[mine])
                right.append(q[mine])

        limit, waiting, held = spaces.budget[block] + 1e-9, [], 0
        for p, q in close_pairs(small, limit):
            good = (visits[p] & visits[q]) == 0
            if across:
                good &= chunk[p] != chunk[q]
            p, q = p[good], q[good]
            far = np.zeros(len(p))
            for at in range(0, small.shape[1], AXES_AT_ONCE):
                far += ((small[p, at : at + AXES_AT_ONCE] - small[q, at : at + AXES_AT_ONCE]) ** 2).sum(axis=1)
                good = far <= limit
                p, q, far = p[good], q[good], far[good]
            if len(p):
                waiting.append((p, q))
                held += len(waiting[-1][0])
            if held > 65536:
                keep(waiting)
                waiting, held = [], 0
        if waiting:
            keep(waiting)
        if not left or not sum(map(len, left)):
            return named([], None, [])
        p, q = np.concatenate(left), np.concatenate(right)
        count = np.bincount(p, times[q], n) + np.bincount(q, times[p], n)
        root = np.arange(n)
        while True:
            low = np.minimum(root[p], root[q])
            now = root.copy()
            np.minimum.at(now, p, low)
            np.minimum.at(now, q, low)
            now = now[now]
            if (now == root).all():
                break
            root = now
        with_links, member = np.flatnonzero(count), np.flatnonzero(root != np.arange(n))
        none = np.concatenate([np.ones(len(with_links), bool), np.zeros(len(member), bool)])
        return named(node[np.concatenate([with_links, member])], pa.array(node[root[np.concatenate([with_links, member])]], pa.int64(), mask=none), np.concatenate([count[with_links], np.zeros(len(member))]).astype(np.int64))

    return rows.groupBy(*keys).applyInArrow(run, "u long, v long, n long")


def unit_vectors(vectors: pa.Array) -> pa.Array:
    """Each vector divided by its length; null for null, empty and zero ones and those with nulls or non-finite numbers."""
    n = len(vectors)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    owner = np.repeat(np.arange(n), sizes)
    good = (sizes > 0) & (np.bincount(owner, ~np.isfinite(flat), n) == 0)
    good &= np.bincount(owner, flat != 0, n) > 0
    flat, sizes = flat[good[owner]], np.where(good, sizes, 0)
    if good.any():
        starts = (np.cumsum(sizes) - sizes)[good]
        flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts), sizes[good])  # so that no square is lost
        flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), sizes[good])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~good, False)), pa.array(flat))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, chunk_rows: int = CHUNK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links and component of every vector: vec_id, n_links, component_id, kept.

    Vectors of equal labels and lengths link if their cosine in double
    precision is ``cosine`` or more.  Null and zero vectors, those that hold
    nulls or non-finite numbers, and those with null labels link with nothing.
    Equal vectors are joined as one that counts as often as it occurs.
    component_id is the least id that links reach; repeated rows stay and link
    with each other; an empty table gives no row; other columns are not read.
    """
    some = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.col(label_col).cast("string").alias("_label"))
    hashed = some.withColumns({"h1": F.xxhash64("_label", "_v"), "h2": F.xxhash64(F.lit("second"), "_v", "_label")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], unit_vectors(batch.column(batch.num_columns - 1))], [*batch.schema.names[:-1], "unit"])

    kind = some.schema["vec_id"].dataType.simpleString()
    sound = hashed.filter("_label is not null").select("vec_id", "h1", "h2", "_label", "_v").mapInArrow(run, f"vec_id {kind}, h1 long, h2 long, _label string, unit array<double>").filter("unit is not null")
    classes = sound.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("_label").alias("_label"), F.first("unit").alias("unit"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "least", "times", F.concat_ws(":", F.size("unit"), "_label").alias("grp"), "unit"), "vector-classes")
    dims = min(classes.agg(F.max(F.size("unit"))).first()[0] or 1, MOST_DIMS)

    spaces = Subspaces(moments(classes, dims), 2 - 2 * cosine, BLOCK_DIMS)
    found = written(links(classes.select("node", "grp", "times", "unit"), spaces, dims, cosine, chunk_rows), "vector-links")
    counts = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("v is not null").select("u", "v"))
    ends = classes.select("node", "h1", "h2", "least", "times").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, F.col("node") == F.col("u"), "left")
    least = ends.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    ends = ends.join(least, F.col("root").bitwiseXOR(F.lit(1)) == F.col("r").bitwiseXOR(F.lit(1))).select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    ends = written(ends, "vector-components")
    out = hashed.select("vec_id", "h1", "h2").join(ends, ["h1", "h2"], "left")  # vectors that may not link have no class
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def near_vectors_sql(cosine: float = 0.98) -> str:
    """DuckDB SQL for ``near_vectors`` of the view ``embeddings``, by brute force."""
    return f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         coalesce(label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS sound
  FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND a.sound AND b.sound AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= {cosine}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links,
       least(e.vec_id, coalesce(m.m, e.vec_id))::BIGINT AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m.m, e.vec_id)) AS kept
FROM e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = e.vec_id"""
