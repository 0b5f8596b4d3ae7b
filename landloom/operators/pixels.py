"""Pixel-wise filters, checks and projections of feature vectors and observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS, FEATURES = 64, 74
INF = float("inf")


def finite(x: Column) -> Column:
    """Neither null nor infinite nor NaN, which is above all numbers; ``x`` stands here once, as filters repeat what they are made of."""
    return F.coalesce(F.abs(x) < F.lit(INF), F.lit(False))


def all_bands(ae: str = "ae") -> Column:
    """Every value is finite and not zero."""
    return F.forall(ae, lambda x: finite(x) & (x != 0))


def any_band(ae: str = "ae") -> Column:
    """Some value is not zero."""
    return F.exists(ae, lambda x: x != 0)


def at_least_bands(k: int, ae: str = "ae") -> Column:
    """At least ``k`` values are not zero."""
    return F.size(F.filter(ae, lambda x: x != 0)) >= k


def labelled(class_id: str = "class_id") -> Column:
    """The label is one of the ten classes."""
    return F.col(class_id).between(1, 10)


def all_known(columns: list[str]) -> Column:
    """All columns are finite and known."""
    return reduce(Column.__and__, (finite(F.col(c)) for c in columns))


def known(pixels: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``pixels`` with ``columns``, where all of these are finite and known.

    The columns are fields of a one-row generator.  A filter on plain columns
    would be put below them, with every band written out in each place that
    uses it, as a method that the JVM only interprets.
    """
    fields = F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items()))))
    return pixels.select("*", fields).filter(all_known(list(columns)))


def fused(pixels: DataFrame, indices: list[str], ae: str = "ae") -> DataFrame:
    """One vector of bands and indices; rows whose vector is short or not finite go."""
    out = pixels.withColumn("features", F.concat(F.col(ae).cast("array<double>"), F.array(*(F.col(c).cast("double") for c in indices))))
    return out.filter((F.size("features") == BANDS + len(indices)) & F.forall("features", finite))


def split_of(u, val: float, test: float) -> Column:
    """Test below ``test``, val in the next ``val``, else train.  V09 checks the shares."""
    check_shares(val, test)
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def two_way_split(u, val: float) -> Column:
    """P40"""
    check_shares(val, 0.0)
    return F.when(u < val, "val").otherwise("train")


def valid_shares(val, test) -> Column:
    """The same rule as a column."""
    return (val >= 0) & (test >= 0) & (val + test < 1)


def check_shares(val: float, test: float) -> None:
    """Shares of a split are not negative and leave some for training."""
    if val < 0 or test < 0 or val + test >= 1:
        raise ValueError("shares of val and test must not be negative and must add up to less than 1")


def standardised(x: str, mu, sigma) -> Column:
    """Z-scores of a vector; a spread of 0 counts as 1."""
    scaled = F.zip_with(F.zip_with(x, mu, lambda a, m: a - m), sigma, lambda a, s: a / F.when(s == 0, 1.0).otherwise(s))
    return scaled


def percentiles(values: DataFrame, column: str, low: float, high: float, accuracy: int = 100_000) -> DataFrame:
    """Exact, interpolated percentiles of a column as one row: _q (both), _lo and _hi (least and greatest value).

    Sketches give bounds between which the wanted ranks lie; only values inside
    them, about 8 / ``accuracy`` of all, are ranked one by one.  What lies before,
    between and behind is counted, with its first and last value kept apart for
    ranks next to a bound.
    """
    v, slack = F.col(column).cast("double"), 2 / accuracy
    ends = [F.lit(min(max(p + s, 0.0), 1.0)) for p in (low, high) for s in (-slack, slack)]
    held = values.select(v.alias("_v")).filter("_v is not null")
    at = held.agg(F.percentile_approx("_v", F.array(*ends), accuracy).alias("_at"))  # one row
    c, a = F.col("_v"), F.col("_at")
    part = F.when(c < a[0], 0).when(c <= a[1], 1).when(c < a[2], 2).when(c <= a[3], 3).otherwise(4)
    near = held.join(F.broadcast(at), how="cross").select("_v", part.alias("_part"))
    runs = near.groupBy("_part", F.when(F.col("_part").isin(1, 3), c).alias("_own")).agg(F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.count("*").alias("_n"))
    split = F.array(F.struct(F.col("_first").alias("v"), (F.col("_n") - 1).alias("n")), F.struct(F.col("_last").alias("v"), F.lit(1).cast("long").alias("n")))
    steps = runs.select(F.explode(split).alias("x")).select("x.*").filter("n > 0").groupBy("v").agg(F.sum("n").alias("n"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # the slices alone
    ranked = steps.select("v", "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))

    out = {"_lo": F.min("v"), "_hi": F.max("v")}
    for k, p in enumerate((low, high)):
        place = F.lit(p) * (F.col("all") - 1)
        out |= {f"_a{k}": value_at(F.floor(place)), f"_b{k}": value_at(F.ceil(place)), f"_f{k}": F.max(place - F.floor(place))}
    row = ranked.agg(*(x.alias(n) for n, x in out.items()))
    return row.select(F.array(*(F.col(f"_a{k}") * (1 - F.col(f"_f{k}")) + F.col(f"_b{k}") * F.col(f"_f{k}") for k in (0, 1))).alias("_q"), "_lo", "_hi")


def stretched(values: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """A band stretched between two percentiles to 0..1; missing values give 0."""
    q = percentiles(values, column, low, high)
    q = q.select(F.when(F.col("_q")[1] <= F.col("_q")[0], F.col("_lo")).otherwise(F.col("_q")[0]).alias("_lo"), F.when(F.col("_q")[1] <= F.col("_q")[0], F.col("_hi")).otherwise(F.col("_q")[1]).alias("_hi"))
    part = (F.col(column) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    return values.join(F.broadcast(q), how="cross").withColumn("stretched", F.coalesce(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).drop("_lo", "_hi")


def clear_or_unknown(threshold: float) -> Column:
    """Quality at the threshold or above, or unknown."""
    return F.col("qa").isNull() | (F.col("qa") >= threshold)


def clear(threshold: float) -> Column:
    """Quality known and at the threshold or above."""
    return F.coalesce(F.col("qa") >= threshold, F.lit(False))


def scenes_between(scenes: DataFrame, start: str, end: str, cloud: float) -> DataFrame:
    """Scenes from a day up to another, with at most so much cloud."""
    return scenes.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")) & (F.col("cloud") <= cloud))


def season(start_month: int, start_day: int, months: int, year) -> tuple[Column, Column]:
    """first day of a season of whole months, and the first day after it."""
    first = F.make_date(year, F.lit(start_month), F.lit(start_day))
    return first, F.add_months(first, months)


def elevation_class(z: str = "z") -> Column:
    """Number of the elevation class, clipped at both ends."""
    # Edges of the classes in metres.
    edges = [-65, 0, 5, 10, 20, 30, 50, 100, 200, 350]
    below = sum((F.when(F.col(z) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(F.col(z).isNotNull(), F.least(F.greatest(below, F.lit(1)), F.lit(len(edges) - 1)))


def shifted_logits(logits: str, log_prior: list[float], tau: float) -> Column:
    """Logits plus a multiple of the logarithms of the class shares."""
    return F.zip_with(logits, F.array(*map(F.lit, log_prior)), lambda a, p: a + tau * p)
