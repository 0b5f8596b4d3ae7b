"""Quality rules: fixed base rules and robust multivariate outliers.

Each text becomes a vector of transformed statistics.  Per language and source
the location and scatter of these vectors are estimated by their minimum
covariance determinant (MCD): the half whose covariance has the least
determinant, found by concentration steps.  Vectors far from it are rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.llm.common import distinct, text_chunks, with_columns_of, word_codes, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rows of a group that one task finds a first estimate on.
BUCKET_ROWS = 500
#: Groups with fewer vectors take the estimate of their language, or of all.
LEAST_ROWS = 60
#: Concentration steps over all rows.
STEPS = 3


def _marks(allowed: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(allowed)] = True
    return table


_SYMBOL = _marks(SYMBOLS)
_UPPER = _marks(bytes(range(65, 91)))
_OTHER = _marks(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def _per_text(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie between one offset and the next."""
    return np.diff(np.searchsorted(at, offsets))


def repeated_words(codes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, words that lie in a window of words found twice or more in it."""
    n = len(codes)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if n < window:
        return np.zeros(len(starts) - 1, np.int64)
    h = owner[: n - window + 1].astype(np.uint64)
    for k in range(window):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - window + 1 + k].astype(np.uint64)
    whole = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    a, b = order[:-1], order[1:]
    same = (h[a] == h[b]) & (owner[a] == owner[b])
    for k in range(window):  # equal hashes are held against the words themselves
        same &= codes[a + k] == codes[b + k]
    found = np.zeros(n + 1, np.int64)
    hit = distinct(np.concatenate([a[same], b[same]]))
    np.add.at(found, hit, 1)
    np.add.at(found, hit + window, -1)
    return _per_text(np.flatnonzero(np.cumsum(found[:n]) > 0), starts)


def statistics(text: pa.Array) -> dict[str, np.ndarray]:
    """The counts in ``COUNTS`` and, for the vectors, n_upper and n_marks of each text."""
    names = [*COUNTS, "n_upper", "n_marks"]
    out = {c: np.zeros(len(text), np.int64) for c in names}
    for row, part in text_chunks(text):
        codes, starts, words = word_codes(part)
        chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        lines = pc.split_pattern(part, "\n")
        owner = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
        flat = lines.flatten()
        full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
        flat, owner = flat.filter(full).dictionary_encode(), owner[full.to_numpy(zero_copy_only=False)]
        keys = owner * (len(flat.dictionary) + 1) + flat.indices.to_numpy(zero_copy_only=False)
        n = len(part)
        made = {
            "n_words": np.diff(starts),
            "word_chars": np.diff(np.concatenate([[0], np.cumsum(chars[codes])])[starts]),
            "n_symbols": _per_text(np.flatnonzero(_SYMBOL[data]), offsets),
            "n_dup_lines": np.bincount(owner, minlength=n) - np.bincount(distinct(keys) // (len(flat.dictionary) + 1), minlength=n),
            "n_repeat_words": repeated_words(codes, starts),
            "n_upper": _per_text(np.flatnonzero(_UPPER[data]), offsets),
            "n_marks": _per_text(np.flatnonzero(_OTHER[data]), offsets),
        }
        for c in names:
            out[c][row : row + n] = made[c]
    return out


#: The vector's parts: name, and the spread below which a difference says nothing.
PARTS = (("word_length", 0.1), ("symbols", 0.15), ("dup_lines", 0.15), ("repeats", 0.1), ("upper", 0.3), ("marks", 0.3))
P = len(PARTS)
FLOOR = np.diag([f * f for _, f in PARTS])
X = [f"x{k}" for k in range(P)]
CELLS = [(i, j) for i in range(P) for j in range(i + 1)]


def vector(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics of texts, shrunk towards plain prose where there are few words."""
    n = c["n_words"] + 20.0
    return np.stack(
        [
            np.log((c["word_chars"] + 100.0) / n),
            np.log1p(10.0 * c["n_symbols"] / n),
            np.log1p(10.0 * c["n_dup_lines"] / n),
            c["n_repeat_words"] / n,
            np.log((c["n_upper"] + 2.0) / (c["word_chars"] + 100.0)),
            np.log((c["n_marks"] + 3.0) / n),
        ],
        axis=1,
    )


def base_failed(n_words, n_repeat_words):
    """The fixed rules: fewer than 10 words, or over a fifth of them in repeated windows."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def measured(docs: DataFrame, text: Callable[[pa.RecordBatch], pa.Array], names: list[str]) -> DataFrame:
    """``docs`` with its counts, base verdict and vector behind all its columns.

    ``text`` finds the texts in a batch of ``docs``; ``names`` are those of the
    columns in ``COUNTS``, base_failed and ``X``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = statistics(text(batch))
            made = [*(c[k] for k in COUNTS), base_failed(c["n_words"], c["n_repeat_words"]), *vector(c).T]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(a)) for a in made)], [*batch.schema.names, *names])

    kinds = [T.LongType()] * len(COUNTS) + [T.BooleanType()] + [T.DoubleType()] * P
    return docs.mapInArrow(run, with_columns_of(docs.schema, list(zip(names, kinds, strict=True))))


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square distribution after Wilson and Hilferty."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def medians(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Median of each column of rows that stand for ``weight`` rows each."""
    order, n = np.argsort(x, axis=0, kind="stable"), int(weight.sum())
    upto = np.cumsum(weight[order], axis=0)
    both = [[np.searchsorted(upto[:, k], at, side="right") for k in range(x.shape[1])] for at in ((n - 1) // 2, n // 2)]
    held = np.take_along_axis(x, order, axis=0)
    return (held[both[0], np.arange(x.shape[1])] + held[both[1], np.arange(x.shape[1])]) / 2


def mcd(x: np.ndarray, weight: np.ndarray | None = None, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Location and regularised scatter of the half of ``x`` with the least determinant.

    Starts from the rows nearest to the medians, by median deviations and by
    plain distance, and concentrates until the half stays the same.  A row may
    stand for ``weight`` equal ones.
    """
    weight = np.ones(len(x), np.int64) if weight is None else weight
    n, best = int(weight.sum()), None
    h = (n + P + 1) // 2 if n > P else n

    def nearest(d: np.ndarray) -> np.ndarray:
        """How many of each row are among the ``h`` nearest."""
        order = np.argsort(d, kind="stable")
        upto = np.minimum(np.cumsum(weight[order]), h)
        out = np.empty(len(x), np.int64)
        out[order] = np.diff(upto, prepend=0)
        return out

    gap = x - medians(x, weight)
    mad = np.maximum(1.4826 * medians(np.abs(gap), weight), np.sqrt(np.diag(FLOOR)))
    for start in (((gap / mad) ** 2).sum(axis=1), (gap**2).sum(axis=1)):
        half = nearest(start)
        for _ in range(steps):
            m = half @ x / h
            s = ((x - m) * half[:, None]).T @ (x - m) / h + FLOOR
            now = nearest(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m))
            if (now == half).all():
                break
            half = now
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0]:
            best = (det, m, s)
    return best[1], best[2]


def _inverted(sums: DataFrame) -> DataFrame:
    """Estimates (grp, m0.., v00..) from rows (grp, n, sums of x, sums of x x)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = np.maximum(f["n"].to_numpy(float), 1)[:, None]
            m = f[[f"s{k}" for k in range(P)]].to_numpy(float) / n
            s = np.empty((len(f), P, P))
            for i, j in CELLS:
                s[:, i, j] = s[:, j, i] = f[f"s{i}_{j}"].to_numpy(float) / n[:, 0] - m[:, i] * m[:, j]
            inv = np.linalg.inv(s + FLOOR)
            yield pd.DataFrame({"grp": f["grp"]} | {f"m{k}": m[:, k] for k in range(P)} | {f"v{i}_{j}": inv[:, i, j] for i, j in CELLS})

    names = [*(f"m{k}" for k in range(P)), *(f"v{i}_{j}" for i, j in CELLS)]
    return sums.mapInPandas(run, "grp string, " + ", ".join(f"{c} double" for c in names))


def _moments(rows: DataFrame) -> DataFrame:
    """Per group: n and the sums of x and x x."""
    return rows.groupBy("grp").agg(
        F.count("*").alias("n"),
        *(F.sum(X[k]).alias(f"s{k}") for k in range(P)),
        *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}_{j}") for i, j in CELLS),
    )


def distance2(x: list[str] = X):
    """Squared Mahalanobis distance of the columns ``x`` from a joined estimate."""
    gap = [F.col(x[k]) - F.col(f"m{k}") for k in range(P)]
    return sum((gap[i] * gap[j] * F.col(f"v{i}_{j}") * (1 if i == j else 2) for i, j in CELLS), F.lit(0.0))


def estimates(rows: DataFrame, groups: DataFrame, steps: int = STEPS) -> DataFrame:
    """MCD estimate of each group, one row per group; ``rows`` has grp, bucket and ``X``.

    ``groups`` has the number of buckets of each group; estimates are repeated
    for each bucket and meet the rows by it, so no join gathers a large group.
    Buckets of about ``BUCKET_ROWS`` rows, equal ones counted, are estimated on
    their own, and their means start the group.  Each step over all rows then takes the half nearest
    to the estimate, by a quantile of the distances, and sums it up: map-side
    sums and sketches, so a group of any size is no task's.  ``scale`` makes
    the median distance that of a chi-square variable, or 1 if it is less.
    """

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(X)
        m, s = mcd(pdf[X].to_numpy(), pdf["times"].to_numpy())
        s, n = s - FLOOR + np.outer(m, m), int(pdf["times"].sum())
        return pd.DataFrame([[key[0], n, *(n * m), *(n * s[i, j] for i, j in CELLS)]])

    buckets = groups.select("grp", "buckets").distinct()

    def met(estimate: DataFrame) -> DataFrame:
        spread = estimate.join(buckets, "grp").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).drop("buckets")
        return rows.join(spread, ["grp", "bucket"])

    names = ["n", *(f"s{k}" for k in range(P)), *(f"s{i}_{j}" for i, j in CELLS)]
    starts = rows.groupBy("grp", "bucket", *X).agg(F.count("*").alias("times")).groupBy("grp", "bucket").applyInPandas(first, "grp string, " + ", ".join(f"{c} double" for c in names))
    now = written(_inverted(starts.groupBy("grp").agg(*(F.sum(c).alias(c) for c in names))), "mcd")
    for _ in range(steps):
        half = met(now).groupBy("grp").agg(F.percentile_approx(distance2(), 0.5, 10_000).alias("half"))
        cut = written(now.join(half, "grp"), "mcd-half")
        now = written(_inverted(_moments(met(cut).filter(distance2() <= F.col("half")))), "mcd")
    spread = met(now).groupBy("grp").agg(F.greatest(F.percentile_approx(distance2(), 0.5, 10_000) / chi2_quantile(0.5, P), F.lit(1.0)).alias("scale"))
    return written(now.join(spread, "grp"), "mcd")


def grouped(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Group of each language and source: gkey, grp, buckets.

    A source with fewer than ``least_rows`` vectors in a language is pooled with
    others like it in that language, and these, if they are too few, with all
    that are in the same case; a pool holds no vectors of larger sources.
    """
    from pyspark.sql import Window

    n = rows.groupBy("gkey", "lkey").count()
    small = F.when(F.col("count") < least_rows, F.col("count"))
    n = n.withColumn("pool", F.sum(small).over(Window.partitionBy("lkey")))
    grp = F.when(F.col("count") >= least_rows, F.concat(F.lit("source "), "gkey")).when(F.col("pool") >= least_rows, F.concat(F.lit("lang "), "lkey")).otherwise("all")
    n = n.withColumn("grp", grp)
    total = n.groupBy("grp").agg(F.ceil(F.sum("count") / BUCKET_ROWS).cast("int").alias("buckets"))
    return written(n.select("gkey", "grp").join(total, "grp"), "groups")


def judged(rows: DataFrame, tail: float, names: list[str], seed: list[Column], lang: Column, source: Column) -> DataFrame:
    """Adds kept, d2 and grp (which estimate judged) to rows that ``measured`` made; other columns come with it.

    All columns of ``rows`` must have names of this module.
    """
    failed, x = F.col(names[len(COUNTS)]), names[len(COUNTS) + 1 :]
    keyed = rows.withColumns({"gkey": F.to_json(F.struct(lang.alias("l"), source.alias("s"))), "lkey": F.to_json(F.struct(lang.alias("l")))})
    fit = keyed.filter(~failed).select("gkey", "lkey", F.xxhash64(*seed).alias("h"), *(F.col(a).alias(b) for a, b in zip(x, X, strict=True)))
    groups = grouped(fit)
    dealt = written(fit.join(groups, "gkey").select("grp", F.pmod("h", "buckets").cast("int").alias("bucket"), *X), "vectors")
    of = written(groups.select("gkey", "grp").join(estimates(dealt, groups), "grp"), "estimates")
    seen = keyed.join(of, "gkey", "left")
    near = distance2(x) / F.col("scale") <= F.lit(chi2_quantile(1 - tail, P))
    return seen.withColumn("d2", distance2(x) / F.col("scale")).withColumn("kept", ~failed & F.coalesce(near, F.lit(True)))


def quality_rules(docs: DataFrame, tail: float = 1e-9, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdict of every whole text: doc_id, the counts, base_failed, kept, distance2, judged_by.

    A text is kept if it passes the base rules and its vector's squared distance
    is one that a share ``tail`` of normal vectors exceeds.  ``judged_by`` names
    the estimate: that of the source, or the pool that ``grouped`` puts it in.
    Null and empty texts have no words and fail; null languages and sources are
    values of their own; repeated rows stay; an empty table gives no row; other
    columns are not read.
    """
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    names = [*COUNTS, "base_failed", *X]
    rows = written(measured(some, lambda batch: batch.column(1), names).drop("_text"), "quality")
    out = judged(rows, tail, names, [F.col(c) for c in ("doc_id", *COUNTS)], F.col("_lang"), F.col("_source"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", F.col("d2").alias("distance2"), F.col("grp").alias("judged_by"))


def good_rows(docs: DataFrame, tail: float = 1e-9, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, whatever their names.

    Texts are written once beside their counts, in a column of their own that
    holds the whole row; only vectors are shuffled.  Null and empty texts go;
    repeated rows are judged alike; an empty table gives no row.
    """
    at, names = docs.columns.index(text_col), [*COUNTS, "base_failed", *X]
    rows = written(measured(docs.select(F.struct("*").alias("_row")), lambda batch: batch.column(0).field(at), names), "quality-rows", "zstd")
    of = {c: F.col("_row").getField(c) for c in (id_col, lang_col, source_col)}
    out = judged(rows, tail, names, [of[id_col], *map(F.col, COUNTS)], of[lang_col], of[source_col])
    return out.filter("kept").select("_row.*")
