"""Toxicity by character n-grams with naive Bayes log-count ratios.

A linear classifier over the character n-grams that occur in a text, each
scaled by the log of the ratio of its smoothed shares in the two classes.  All
n-grams count that are frequent enough and whose shares differ significantly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.llm.common import distinct, fresh_name, text_chunks, with_columns_of, written

ORDERS = (4, 5, 7)
HASH_BITS = 24
#: Labelled documents that the classifier is fitted on, at most.
TRAIN_ROWS = 5_000
#: n-grams count that this many documents have, and whose chi-square statistic is one that a tenth exceeds by chance.
LEAST_ROWS, LEAST_CHI2 = 3, 2.706
#: Strength of the squared penalty on weights.
PENALTY = 1e-2
THRESHOLD = 0.3
_STEP_BYTES = 1 << 20
_PAD = " " * max(ORDERS)


def hashed_grams(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Hashes of the n-grams that begin at each character, in steps of some texts.

    Yields the first row, the end of each text among the characters of the step,
    whether n-grams that begin at a character count, and an array of hashes for
    each order.  Texts are lower-cased, every white space counts as a space, and
    spaces stand on both sides.
    """
    for row, part in text_chunks(text, _STEP_BYTES):
        low = [" " + t.lower() for t in part.to_numpy(zero_copy_only=False).tolist()]
        ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + len(_PAD))
        chars = np.frombuffer((_PAD.join(low) + _PAD).encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.where((chars >= 9) & (chars <= 13), np.uint32(32), chars)
        inside = np.ones(len(chars), bool)
        for k in range(len(_PAD)):
            inside[ends - 1 - k] = False
        h, hashes = chars, []
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint32(0x9E3779B1) + chars[n - 1 :]
            if n in ORDERS:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                hashes.append((mixed >> np.uint32(32 - HASH_BITS)).astype(np.int32))
        yield row, ends, inside, hashes


def marked(hashes: np.ndarray) -> np.ndarray:
    """One bit for each hash, set for those in ``hashes``."""
    used = np.zeros(1 << HASH_BITS, bool)
    used[hashes] = True
    return np.packbits(used, bitorder="little")


def occurring(text: pa.Array, used: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, text numbers and hashes of the distinct n-grams of each text.

    With ``used`` only hashes whose bit it has.
    """
    for row, ends, inside, hashes in hashed_grams(text):
        found = []
        for h in hashes:
            at = np.flatnonzero(inside[: len(h)] if used is None else inside[: len(h)] & (used[h >> 3] >> (h & 7).astype(np.uint8)) & 1)
            found.append((np.searchsorted(ends, at, side="right") << HASH_BITS) | h[at])
        found = distinct(np.concatenate(found))
        yield row, found >> HASH_BITS, found & ((1 << HASH_BITS) - 1)


@dataclass
class Model:
    """Bias and, by n-gram hash, weight times log-count ratio."""

    bias: float
    hashes: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        """Function that gives the probability of the label 1 for each text."""
        used, weight = marked(self.hashes), np.zeros(1 << HASH_BITS, np.float32)
        weight[self.hashes] = self.weights

        def scores(text: pa.Array) -> np.ndarray:
            out = np.full(len(text), self.bias)
            for row, doc, gram in occurring(text, used):
                sums = np.bincount(doc, weight[gram])
                out[row : row + len(sums)] += sums
            return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

        return scores


def constant(n: int, n1: int) -> Model:
    """The model that gives every text the smoothed share of the label 1."""
    return Model(float(np.log((n1 + 0.5) / (n - n1 + 0.5))) if n else -20.0, np.empty(0, np.int64), np.empty(0))


def log_ratios(n_with: np.ndarray, n1_with: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Log of the ratio of an n-gram's smoothed shares in documents of label 1 and 0."""
    return np.log((n1_with + 1) / (n1 + 2)) - np.log((n_with - n1_with + 1) / (n - n1 + 2))


def descended(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """Where a smooth convex function is least, by limited-memory quasi-Newton steps."""
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    value, slope = cost(w)
    for _ in range(steps):
        way, shares = slope.copy(), []
        for s, y in reversed(moves):
            shares.append(s @ way / (s @ y))
            way -= shares[-1] * y
        way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(float(np.linalg.norm(slope)), 1e-12)
        for (s, y), share in zip(moves, reversed(shares), strict=True):
            way += s * (share - y @ way / (s @ y))
        length = 1.0
        while True:
            there = w - length * way
            now, steep = cost(there)
            if now <= value - 1e-4 * length * (slope @ way) or length < 1e-6:
                break
            length /= 2
        if (there - w) @ (steep - slope) > 1e-12:
            moves = [*moves[1 - memory :], (there - w, steep - slope)]
        done = value - now < 1e-7 * max(1.0, value)
        w, value, slope = there, now, steep
        if done:
            break
    return w


def fit(doc: np.ndarray, col: np.ndarray, ratio: np.ndarray, label: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Bias and weights from pairs of document and n-gram: both labels weigh the same in all."""
    n, n1 = len(label), int(label.sum())
    share = np.where(label == 1, 0.5 / n1, 0.5 / (n - n1))

    def cost(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = w[-1] + np.bincount(doc, (w[:-1] * ratio)[col], n)
        slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) * share
        value = share @ (np.logaddexp(0, z) - label * z) + penalty / 2 * (w[:-1] @ w[:-1])
        return float(value), np.append(np.bincount(col, slope[doc], len(ratio)) * ratio + penalty * w[:-1], slope.sum())

    w = descended(cost, np.append(np.zeros(len(ratio)), np.log(n1 / (n - n1))))
    return float(w[-1]), w[:-1]


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """_id, _label and _text of at most ``rows`` labelled documents, those with the least hashes of their ids.

    An id with both labels counts as 1; of the texts of an id the least is taken.
    Only ids are sorted; the texts are not gathered.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_label in (0, 1) and _id is not null")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sample = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # the sample is bounded, so its ids may be sent to all tasks
    return written(texts.join(F.broadcast(sample), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")), "toxicity-rows", "zstd")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``rows`` labelled documents (see ``training_rows``).

    ``labels`` holds only rows that may be learnt from.  n-grams are counted by
    tasks and summed up by hash; the fit itself gets a document's n-grams that
    are used, no text, and the driver these n-grams' counts and weights.
    """
    sample = training_rows(docs, labels, rows, id_col, text_col, label_col)
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if n1 in (0, n):
        return constant(n, n1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for row, doc, gram in occurring(batch.column(0)):
                keys = np.sort(gram << 1 | label[doc + row])
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first] >> 1), pa.array(np.diff(np.append(first, len(keys)))), pa.array(keys[first] & 1)], ["gram", "n", "label"])

    counts = sample.select("_text", "_label").mapInArrow(counted, "gram long, n long, label long")
    counts = counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("n1"))
    expected = F.col("n") * F.lit(n1 / n)
    chi2 = (F.col("n1") - expected) ** 2 / (expected * F.lit(1 - n1 / n))
    chosen = counts.filter((F.col("n") >= LEAST_ROWS) & (F.col("n") < n) & (chi2 >= LEAST_CHI2)).toPandas().sort_values("gram")
    grams = chosen["gram"].to_numpy(np.int64)
    ratio = log_ratios(chosen["n"].to_numpy(float), chosen["n1"].to_numpy(float), n, n1)
    if not len(grams):
        return constant(n, n1)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = marked(grams)
        for batch in batches:
            cols: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for row, doc, gram in occurring(batch.column(0), used):
                places = np.searchsorted(grams, gram).astype(np.int32)
                ends = np.searchsorted(doc, np.arange(doc[-1] + 2 if len(doc) else 0))
                for k in range(len(ends) - 1):
                    cols[row + k].append(places[ends[k] : ends[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([b"".join(c) for c in cols], pa.binary())], ["_id", "_label", "cols"])

    kind = sample.schema["_id"].dataType.simpleString()
    pairs = sample.select("_text", "_label", "_id").mapInArrow(taken, f"_id {kind}, _label int, cols binary").repartition(1).sortWithinPartitions("_id")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, cols = [], []
        for batch in batches:
            label.append(batch.column(1).to_numpy(zero_copy_only=False))
            cols += [np.frombuffer(c, np.int32) for c in batch.column(2).to_pylist()]
        size = np.fromiter(map(len, cols), np.int64, len(cols))
        bias, w = fit(np.repeat(np.arange(len(cols)), size), np.concatenate(cols), ratio, np.concatenate(label))
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([(w * ratio).tobytes()], pa.binary())], ["bias", "weights"])

    ((bias, weights),) = pairs.mapInArrow(fitted, "bias double, weights binary").collect()
    return Model(bias, grams, np.frombuffer(weights, float))


def may_learn(id_col: str = "doc_id", held_out: int = 2) -> F.Column:
    """Whether a label is for learning: CRC-32 of the id as text, modulo 4, is not ``held_out``."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != held_out


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with its score and its predicted label behind all its columns.

    Null and empty texts get the score of a text without n-grams; texts of any
    length are scored whole; repeated rows stay; an empty table gives no row.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            score = scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, with_columns_of(docs.schema, [(names[0], T.DoubleType()), (names[1], T.IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score of every whole text: doc_id, held_out, score, predicted.

    Labels whose id has remainder 2 are never learnt from.  Ids, languages and
    sources are no input of a score.  A null id is held out; repeated rows
    stay; an empty table gives no row; without labels of both classes every
    score is the same.
    """
    model = train(docs, labels.filter(may_learn(id_col)), id_col=id_col, text_col=text_col, label_col=label_col)
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return scored(some, model, text_col="_text").select("doc_id", F.coalesce(~may_learn("doc_id"), F.lit(True)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Rows with null ids or texts are judged like any other; repeated rows go or
    stay together; an empty table gives no row; without labels of both classes
    all rows are judged by the share of the label 1.
    """
    model = train(docs, labels.filter(may_learn(id_col)), id_col=id_col, text_col=text_col, label_col=label_col)
    names = (fresh_name(docs.columns, "score"), fresh_name(docs.columns, "predicted"))
    return scored(docs, model, text_col=text_col, names=names).filter(F.col(names[1]) == 0).select(*docs.columns)
