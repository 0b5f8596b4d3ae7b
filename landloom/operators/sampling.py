"""Samples of labelled pixels: caps, class weights, statistics and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions.counter import below, mixed
from landloom.operators.pixels import finite
from landloom.operators.raster import interior
from landloom.sources.shared import written

#: Parts that the candidates of a group are cut into at each pass, and sampled rows for each bound between them.
PARTS, DRAWN = 64, 4
#: Rows of a group that a rank may see; more are narrowed down by counts first.
SECOND_RANK_ROWS = 100_000


def _bounds(near: DataFrame, parts: int, turn: int) -> DataFrame:
    """Up to ``parts`` - 1 bounds per group from a sample of its candidates: they set the pace, never the result."""
    share = F.pmod(F.xxhash64("_at", F.lit(turn)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * parts * DRAWN / F.col("_n")
    drawn = near.filter(share).groupBy("_g").agg(F.sort_array(F.collect_list("_at")).alias("_s"))
    every = F.greatest(F.floor(F.size("_s") / parts), F.lit(1)).cast("int")
    return drawn.select("_g", F.filter(F.col("_s"), lambda _, k: (k + 1) % every == 0).alias("_bounds"))


_INSIDE = "(_lo IS NULL OR _at > _lo) AND (_hi IS NULL OR _at <= _hi)"
#: A group whose candidates are all equal in order can't be narrowed further.
_WIDE = "_lo IS NULL OR _hi IS NULL OR _lo < _hi"


def _narrowed(narrow: DataFrame, cap: int, parts: int) -> DataFrame:
    """Between which values (above _lo, up to _hi) groups with more than ``cap`` rows are cut, with the number of candidates and of those to take.

    Candidates of a group are counted between bounds drawn from them, and only
    those between the two around the ``cap``-th one go on, until few enough are
    left to be ranked.  A pass divides them by about ``parts``.
    """
    state = narrow.groupBy("_g").agg(F.count("*").alias("_n")).filter(F.col("_n") > cap)
    state = written(state.select("_g", "_n", F.lit(cap).cast("long").alias("_left"), F.lit(None).cast(narrow.schema["_at"].dataType).alias("_lo"), F.lit(None).cast(narrow.schema["_at"].dataType).alias("_hi")), "cuts")
    turn, done = 0, None
    while True:
        small = F.col("_n") <= SECOND_RANK_ROWS
        ready = state.filter(small | ~F.expr(_WIDE))
        done = ready if done is None else done.unionByName(ready)
        state = state.filter(~small & F.expr(_WIDE))
        if state.isEmpty():
            break
        near = narrow.join(state, "_g").filter(_INSIDE)
        bounds = written(_bounds(near, parts, turn), "bounds")
        cut = near.join(bounds, "_g", "left").withColumn("_bounds", F.coalesce("_bounds", F.array().cast(near.select(F.array("_at").alias("a")).schema["a"].dataType)))
        part = F.size(F.filter("_bounds", lambda p: p < F.col("_at")))
        counts = cut.withColumn("_part", part).groupBy("_g", "_part").agg(F.count("*").alias("_c"), F.first("_left").alias("_left"), F.max("_at").alias("_most"), F.min("_at").alias("_least"))
        w = Window.partitionBy("_g").orderBy("_part")  # one row per part
        sums = counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).filter((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_c") >= F.col("_left")))
        # a part of equal values has equal bounds, and is then taken as it is
        below = F.when(F.col("_least") == F.col("_most"), F.col("_most")).otherwise(None)
        kept = sums.join(state.select("_g", "_lo"), "_g").join(bounds, "_g", "left")
        lo = F.coalesce(below, F.when(F.col("_part") > 0, F.get("_bounds", F.col("_part") - 1)), F.col("_lo"))
        state = written(kept.select("_g", F.col("_c").alias("_n"), (F.col("_left") - F.col("_before")).alias("_left"), lo.alias("_lo"), F.col("_most").alias("_hi")), "cuts")
        turn += 1
    return done


def _cut_rows(narrow: DataFrame, cap: int, parts: int) -> DataFrame:
    """Where groups with more than ``cap`` rows are cut (_g, _cut): the ``cap``-th value of their order; and how many rows that have it are taken."""
    done = _narrowed(narrow, cap, parts)
    last = narrow.join(done.filter(_WIDE), "_g").filter(_INSIDE)
    w = Window.partitionBy("_g").orderBy("_at")
    # the first of the rows that are equal to the cut tells how many come before them
    nth = last.withColumns({"_r": F.row_number().over(w), "_first": F.rank().over(w)}).filter(F.col("_r") == F.col("_left"))
    exact = nth.select("_g", F.col("_at").alias("_cut"), (F.col("_left") - F.col("_first") + 1).alias("_take"))
    return exact.unionByName(done.filter(f"NOT ({_WIDE})").select("_g", F.col("_hi").alias("_cut"), F.col("_left").alias("_take")))


def capped(rows: DataFrame, by: list[str], order: list[Column], cap: int, salts: int = PARTS) -> DataFrame:
    """The first ``cap`` rows of each group in an order; of rows that are equal in it, any.

    The place of the cut is found by counting (``salts`` is the number of parts
    of a pass), and then rows are kept or left by comparing with it.  So no task
    sorts a group, however many rows and whatever share of all it has; only rows
    equal to the cut in every column of the order are numbered.  Null comes first.
    """
    names = [f"_o{k}" for k in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order, strict=True))).withColumns({"_g": F.struct(*by), "_at": F.struct(*names)})
    cuts = written(_cut_rows(written(keyed.select("_g", "_at"), "orders"), cap, salts), "cuts")
    met = keyed.join(cuts, "_g", "left")
    kept = met.filter(F.col("_cut").isNull() | (F.col("_at") < F.col("_cut"))).select(*rows.columns)
    edge = met.filter(F.col("_at") == F.col("_cut")).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_at")))
    return kept.unionByName(edge.filter(F.col("_r") <= F.col("_take")).select(*rows.columns))


def capped_by_area(rows: DataFrame, area_cap: int, train: int, val: int, order: list[Column]) -> DataFrame:
    """At most ``area_cap`` rows per class and area, then a number per class and split."""
    inside = written(capped(rows, ["class_id", "area"], order, area_cap), "capped")
    parts = [capped(inside.filter(F.col("split") == s), ["class_id"], order, n) for s, n in (("train", train), ("val", val))]
    return parts[0].unionByName(parts[1])


def eroded_training(rows: DataFrame, reach: int) -> DataFrame:
    """Training rows only where the whole neighbourhood has their class (G36); other splits stay as they are."""
    return interior(rows, reach).filter("split = 'train'").unionByName(rows.filter("split is null or split <> 'train'"))


def shuffled(rows: DataFrame, seed: int, columns: list[str]) -> DataFrame:
    """Rows in an order that a seed decides, by counters of ``columns``, whole numbers."""
    return rows.orderBy(mixed(seed, *map(F.col, columns)), *columns)


def class_weights(rows: DataFrame, classes: int = 10) -> DataFrame:
    """N / (k n_c) scaled to a mean of 1 over classes that occur.  A30: 1 / n_c scaled to a sum of k.  A31: n_c / n."""
    n = rows.groupBy("class_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # one row per class
    raw = F.sum("n").over(w) / (F.lit(classes) * F.col("n"))
    inverse = 1.0 / F.col("n")
    return n.select("class_id", "n", (raw / F.avg(raw).over(w)).alias("balanced"), (inverse / F.sum(inverse).over(w) * classes).alias("inverse"), (F.col("n") / F.sum("n").over(w)).alias("prior"))


def feature_statistics(rows: DataFrame, features: str) -> DataFrame:
    """Mean and population deviation per position of the vectors of training rows; a deviation of 0 is 1."""
    long = rows.filter("split = 'train'").select(F.posexplode(features).alias("pos", "v"))
    sd = F.stddev_pop("v")
    return long.groupBy("pos").agg(F.avg("v").alias("mu"), F.when(sd == 0, 1.0).otherwise(sd).alias("sigma"))


def split_counts(rows: DataFrame) -> DataFrame:
    """Rows per split and class, with percent of the split and of all."""
    n = rows.groupBy("split", "class_id").agg(F.count("*").alias("n"))
    return n.withColumns({"pct_split": F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("split")), "pct_all": F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())})


def split_sizes(rows: DataFrame) -> DataFrame:
    """Rows per split and their share."""
    n = rows.groupBy("split").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def sample_statistics(rows: DataFrame) -> DataFrame:
    """Rows per area, split and class, with totals per area and split, per area, and overall."""
    return rows.rollup("area", "split", "class_id").agg(F.count("*").alias("n"))


def label_presence(rows: DataFrame, classes: int = 10) -> DataFrame:
    """Labels that occur in a split, that are missing, and that are none of the classes."""
    every = F.sequence(F.lit(1), F.lit(classes))
    seen = rows.groupBy("split").agg(F.array_sort(F.collect_set("class_id")).alias("seen"))
    return seen.select("split", F.array_intersect(every, "seen").alias("present"), F.array_except(every, "seen").alias("missing"), F.array_except("seen", every).alias("invalid"))


def blocks_per_split(rows: DataFrame) -> DataFrame:
    """Blocks of each area with their split."""
    return rows.select("area", "block_id", "split").distinct()


def archive_checks(rows: DataFrame, features: str, n_features: int) -> DataFrame:
    """One row per check of a sample with the number of offending rows, in one pass."""
    checks = {
        "length": F.size(features) != n_features,
        "not_finite": ~F.forall(features, finite),
        "label_range": ~F.coalesce(F.col("class_id").between(1, 10), F.lit(False)),
        "split_name": ~F.col("split").isin("train", "val", "test"),
        "sample_id": F.col("sample_id").isNull(),
    }
    counts = rows.agg(*(F.count_if(c).alias(k) for k, c in checks.items()))
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("offending")) for k in checks))).alias("c")).select("c.*")
    return long.withColumn("ok", F.col("offending") == 0)


def array_summary(rows: DataFrame, features: str) -> DataFrame:
    """Number, range, mean, deviation and share of finite values of all vectors."""
    v = rows.select(F.explode(features).alias("v"))
    good = F.when(finite(F.col("v")), F.col("v").cast("double"))
    return v.agg(F.count("*").alias("n"), F.min(good).alias("min"), F.max(good).alias("max"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"), (F.count(good) / F.count("*")).alias("finite_share"))


def numbered(rows: DataFrame, by: str, order: list[str], per_task: int = 100_000) -> DataFrame:
    """Adds ``_place``, from 0, among the rows that share ``by``, of which there are few values.

    They are in the order of a number by counter of ``order``, whole numbers,
    and then of these.  Rows of a value are dealt to buckets of about
    ``per_task`` by ranges of that number and numbered there; a bucket's first
    number is a running sum over buckets.
    """
    n = rows.groupBy(by).agg(F.ceil(F.count("*") / per_task).alias("_buckets"))
    dealt = rows.join(n, by).withColumn("_mixed", mixed(0, *map(F.col, order)))
    dealt = dealt.withColumn("_bucket", F.shiftrightunsigned(F.col("_mixed") * F.col("_buckets"), 32))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(by, "_bucket").agg(F.count("*").alias("_n")).select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inner = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy("_mixed", *order)) - 1
    return dealt.withColumn("_inner", inner).join(first, [by, "_bucket"]).withColumn("_place", F.col("_inner") + F.col("_first")).drop("_buckets", "_bucket", "_first", "_inner", "_mixed")


def balanced_draw(rows: DataFrame, seed: int, keys: list[str], factor: int = 1) -> DataFrame:
    """As many rows as there are, times ``factor``, drawn with replacement; classes weigh the same.

    Each draw takes a class, then one of its rows, by counters of its number, so
    reruns agree; ``copy`` tells the draws of a row apart.  ``keys``, whole
    numbers, tell the rows of a class apart.
    """
    every = Window.partitionBy()
    classes = rows.groupBy("class_id").agg(F.count("*").alias("_n"))
    classes = classes.withColumns({"_k": F.row_number().over(Window.orderBy("class_id")) - 1, "_classes": F.count("*").over(every), "_total": F.sum("_n").over(every)})
    total = classes.agg(F.max("_total")).first()[0] or 0
    draws = rows.sparkSession.range(total * factor).withColumnRenamed("id", "copy")
    drawn = draws.join(F.broadcast(classes), below(F.col("_classes"), seed, F.lit(0), F.col("copy")) == F.col("_k"))  # one row per class
    drawn = drawn.select("copy", "class_id", below(F.col("_n"), seed, F.lit(1), F.col("copy")).alias("_place"))
    return numbered(rows, "class_id", keys).join(drawn, ["class_id", "_place"]).drop("_place").select(*rows.columns, "copy")
