"""Packing into as few sequences as possible by local search from best fit.

Bins of equal contents are one pattern with a count, so the search sees the
histogram of lengths and never a document: at most ``max_len`` numbers reach the
driver.  An exchange between two patterns is made for as many pairs of bins as
both have.  Pieces meet their places by the rank they have among the pieces of
their length, which is counted where they are made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landloom.llm.common import written
from landloom.llm.packing import slots
from landloom.llm.tokens import crc32, encoded, encoder

#: Exchanges of the search at most; what it has by then is a whole packing all the same.
MOST_EXCHANGES = 20_000

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], max_len: int) -> Counter[Pattern]:
    """Bins by pattern after best fit from the longest piece down: the fullest bins with room take as many pieces as they hold."""
    bins: Counter[Pattern] = Counter()
    by_room: list[list[Pattern]] = [[] for _ in range(max_len + 1)]

    def put(pattern: Pattern, n: int) -> None:
        if pattern not in bins:
            by_room[max_len - sum(pattern)].append(pattern)
        bins[pattern] += n

    for length in sorted(counts, reverse=True):
        left, room = counts[length], length
        while left:
            while room <= max_len and not by_room[room]:
                room += 1
            if room > max_len:  # new bins
                pattern, n, room = (), left, max_len
            else:
                pattern = by_room[room].pop()
                n = bins.pop(pattern)
            each = min(room // length, left)
            used = min(n, left // each)
            left -= used * each
            if pattern and n > used:
                put(pattern, n - used)
            put(pattern + (length,) * each, used)
            room = length
    return bins


def fewest(counts: dict[int, int], max_len: int) -> int:
    """A number of bins that no packing can undercut.

    For any t up to half a bin: pieces above ``max_len`` - t share one with no
    piece of at least t, other pieces above half a bin need one each, and the
    rest of at least t fit only into what these leave.
    """
    n = np.zeros(max_len + 1, np.int64)
    for length, k in counts.items():
        n[length] = k
    number, total = np.cumsum(n), np.cumsum(n * np.arange(max_len + 1))
    half, most = max_len // 2, 0
    for t in range(half + 1):
        alone, big = number[-1] - number[max_len - t], number[max_len - t] - number[half]
        space = big * max_len - (total[max_len - t] - total[half])
        rest = total[half] - (total[t - 1] if t else 0)
        most = max(most, int(alone + big) + max(0, -(-int(rest - space) // max_len)))
    return most


class Underfull:
    """Patterns with room, and for each the least sum of pieces at or above any number that it can give.

    ``single`` counts no piece and single ones, ``double`` pairs too.
    """

    def __init__(self, max_len: int):
        self.max_len, self.at, self.free = max_len, {}, []
        self.names: list[Pattern | None] = []
        self.fill, self.count, self.stuck = (np.zeros(0, np.int64) for _ in range(3))
        self.single, self.double = (np.zeros((0, max_len + 2), np.int32) for _ in range(2))

    def put(self, pattern: Pattern, n: int) -> None:
        """Change the number of bins of ``pattern`` by ``n``."""
        if pattern not in self.at:
            if not self.free:
                grown = max(64, len(self.names))
                self.free = list(range(len(self.names), len(self.names) + grown))
                self.names += [None] * grown
                self.fill, self.count, self.stuck = (np.concatenate([x, np.zeros(grown, np.int64)]) for x in (self.fill, self.count, self.stuck))
                self.single, self.double = (np.concatenate([x, np.zeros((grown, self.max_len + 2), np.int32)]) for x in (self.single, self.double))
            k = self.at[pattern] = self.free.pop()
            self.names[k], self.fill[k], self.stuck[k] = pattern, sum(pattern), 0
            for table, sums in ((self.single, {0, *pattern}), (self.double, {0, *pattern, *gifts(pattern)})):
                known = np.array(sorted(sums))
                nxt = np.searchsorted(known, np.arange(self.max_len + 2))
                table[k] = np.append(known, self.max_len + 1)[nxt]
        k = self.at[pattern]
        self.count[k] += n
        if not self.count[k]:
            self.free.append(self.at.pop(pattern))
            self.names[k] = None

    def emptiest(self) -> Pattern | None:
        """The pattern with most room of those that aren't stuck."""
        fill = np.where((self.count > 0) & (self.stuck == 0), self.fill, self.max_len)
        k = int(fill.argmin()) if len(fill) else 0
        return self.names[k] if len(fill) and fill[k] < self.max_len else None

    def exchange(self, victim: Pattern) -> tuple[Pattern, int, int] | None:
        """The pattern, what it gets from ``victim`` and what it gives, by which squared fill grows most; None if it cannot grow."""
        own, fill = self.at[victim], sum(victim)
        best, most = None, 0
        others = (self.count > 0) & (self.fill >= fill)
        others[own] &= self.count[own] > 1
        rows = np.flatnonzero(others)
        room = self.max_len - self.fill[rows]
        for get, table in [*((t, self.double) for t in set(victim)), *((t, self.single) for t in gifts(victim))]:
            more = get - table[rows, np.clip(get - room, 0, None)]
            gain = np.where(more > 0, 2 * more * (self.fill[rows] - fill + more), 0)
            at = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[at] > most:
                most, best = gain[at], (self.names[rows[at]], get, int(get - more[at]))
        return best


def gifts(pattern: Pattern) -> dict[int, Pattern]:
    """Pairs of a bin's pieces by their sum."""
    kinds = Counter(pattern)
    return {a + b: (a, b) for a in kinds for b in kinds if a < b or (a == b and kinds[a] > 1)}


def traded(pattern: Pattern, out: Pattern, into: Pattern) -> Pattern:
    """``pattern`` without the pieces ``out`` and with ``into``."""
    left = Counter(pattern)
    left.subtract(out)
    return tuple(sorted([*left.elements(), *into], reverse=True))


def improved(bins: Counter[Pattern], max_len: int, goal: int, exchanges: int = MOST_EXCHANGES) -> Counter[Pattern]:
    """``bins`` after local search: moves and exchanges of one for one and two for one that raise squared fill.

    The emptiest bins give first, to bins at least as full, by the exchange
    that gains most, for as many pairs of bins as there are.  It ends at
    ``goal`` bins, after ``exchanges``, or when no exchange gains.
    """
    done = Counter({p: n for p, n in bins.items() if sum(p) == max_len})
    open_bins = Underfull(max_len)
    for pattern, n in bins.items():
        if sum(pattern) < max_len:
            open_bins.put(pattern, n)
    number, made, fresh = bins.total(), 0, False
    while number > goal and made < exchanges:
        victim = open_bins.emptiest()
        if victim is None and not fresh:
            break
        if victim is None:  # others have changed since these were stuck
            open_bins.stuck[:], fresh = 0, False
            continue
        found = open_bins.exchange(victim)
        if found is None:
            open_bins.stuck[open_bins.at[victim]] = 1
            continue
        partner, get, give = found
        have = int(open_bins.count[open_bins.at[victim]])
        n = have // 2 if partner == victim else min(have, int(open_bins.count[open_bins.at[partner]]))
        double = give not in partner and give > 0
        gets = (get,) if double or get in victim else gifts(victim)[get]
        gives = () if not give else gifts(partner)[give] if double else (give,)
        for pattern, change in ((victim, -n), (partner, -n), (traded(victim, gets, gives), n), (traded(partner, gives, gets), n)):
            if not pattern:
                number -= n
            elif sum(pattern) == max_len:
                done[pattern] += change
            else:
                open_bins.put(pattern, change)
        made, fresh = made + 1, True
    for pattern, k in open_bins.at.items():
        done[pattern] += int(open_bins.count[k])
    return done


def pack_best(counts: dict[int, int], max_len: int) -> list[tuple[int, list[int]]]:
    """Patterns ``(how often, lengths)`` that hold every piece once, in as few bins as the search finds."""
    bins = improved(best_fit(counts, max_len), max_len, fewest(counts, max_len))
    return [(n, list(p)) for p, n in sorted(bins.items(), key=lambda x: (-sum(x[0]), x[0]))]


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents, with ``part``, the task that made a piece, and ``nth``, its place among those of its length in this task.

    All pieces of a document but its last one have ``max_len`` ids.
    """
    some = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = some.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for row, ids in encoded(encoder(tokenizer_path), batch.column(1), end_id):
                for piece, at in enumerate(range(0, len(ids), max_len)):
                    some = ids[at : at + max_len]
                    out.append((row, piece, at, len(some), crc32(some), part, met[len(some)]))
                    met[len(some)] += 1
            row, piece, *rest = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return some.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long")


def placed(pieces: DataFrame, max_len: int) -> DataFrame:
    """Adds sequence_id and offset to written ``pieces`` (see ``cut``)."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    at = slots(pack_best(histogram, max_len))
    key = at["length"] * (1 << 44) + at["first"]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = pieces.join(first, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("first")).drop("part", "nth", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            nth = rank - at["first"][k]
            made = [at["sequence"][k] + nth // at["each"][k], at["offset"][k] + nth % at["each"][k] * length]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], [*batch.schema.names, "sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kept}, sequence_id long, offset long").drop("rank")


def best_packed(docs: DataFrame, tokenizer_path: str, end_id: int = 0, max_len: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place whole documents in few sequences of at most ``max_len`` ids.

    Only a document that is longer with its end id is cut, into full pieces and
    a last one.  Returns doc_id, piece, start, length, ids_crc32, sequence_id and
    offset per piece; pieces of a sequence follow each other from offset 0
    without a gap.  A null or empty text is one piece with the end id alone;
    repeated rows and null ids are documents like any other; an empty table
    gives no row; other columns are not read.

    Rows shuffle once, by length and by the task that made them, so the pieces
    of a hot length or of equal documents never meet in one task.
    """
    pieces = written(cut(docs, tokenizer_path, end_id, max_len, id_col, text_col), "pieces")
    return placed(pieces, max_len).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
