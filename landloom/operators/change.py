"""Changes of land cover between two dates.

Pixels come as rows with classes ``c1`` and ``c2`` (1 to 10, null for nodata)
and, where asked for, ``zone`` and uncertainties ``u1`` and ``u2``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions.counter import mixed
from landloom.functions.names import class_name


def old() -> Column:
    return F.col("c1")


def new() -> Column:
    return F.col("c2")


# Focus maps and the label of each.
FOCUS = {
    "map1_urban_infrastructure_expansion": "Urban & Infrastructure Expansion",
    "map2_rural_settlement_expansion": "Rural Settlement Expansion",
    "map3_productive_land_conversion": "Productive Land Conversion",
    "map4_water_expansion_erosion": "Water Expansion / Erosion",
    "map5_ecological_recovery": "Ecological Recovery",
    "map6_ecological_degradation": "Ecological Degradation",
}


def valid() -> Column:
    """Both classes are among the ten."""
    return F.coalesce(old().between(1, 10) & new().between(1, 10), F.lit(False))


def changed() -> Column:
    """Both classes are valid and differ."""
    return valid() & (old() != new())


def both_years(pixels: DataFrame, year1: int = 2017, year2: int = 2024) -> DataFrame:
    """Class and uncertainty of two years side by side, where both have the pixel."""
    one = pixels.filter(F.col("year") == year1).select("px_row", "px_col", F.col("class_id").alias("c1"), F.col("uncertainty").alias("u1"))
    two = pixels.filter(F.col("year") == year2).select("px_row", "px_col", F.col("class_id").alias("c2"), F.col("uncertainty").alias("u2"))
    return one.join(two, ["px_row", "px_col"])


def pairwise_uncertainty(pixels: DataFrame) -> DataFrame:
    """Mean and maximum of both uncertainties where both are known."""
    both = F.col("u1").isNotNull() & F.col("u2").isNotNull()
    return pixels.withColumns({"u_mean": F.when(both, (F.col("u1") + F.col("u2")) / 2), "u_max": F.when(both, F.greatest("u1", "u2"))})


def focus_flags() -> dict[str, Column]:
    """Six flags of a changed pixel, which may overlap."""
    rules = [
        new().isin(1, 3),
        new() == 2,
        new().isin(5, 6) | (new() == 4) & (old() != 6),
        (new() == 8) | (new() == 7) & (old() != 8),
        (new() == 9) | (new() == 5) & (old() != 9),
        (old() == 9) | (old() == 5) & (new() != 9),
    ]
    return {k: F.coalesce(changed() & r, F.lit(False)) for k, r in zip(FOCUS, rules, strict=True)}


def display_code(flag: Column) -> Column:
    """0 unchanged, 1 in focus, 2 other change, null for nodata."""
    return F.when(~valid(), F.lit(None)).when(old() == new(), 0).when(flag, 1).otherwise(2)


def change_group() -> Column:
    """P25: one group of a pixel by priority; 0 unchanged, 7 other, null for nodata."""
    lost = (old() == 9) | (old() == 5) & ~new().isin(5, 9)
    made = new().isin(5, 6) | (new() == 4) & (old() != 6)
    return (
        F.when(~valid(), F.lit(None)).when(old() == new(), 0).when(new().isin(1, 3), 1).when(new() == 2, 2).when(new().isin(7, 8), 4).when(new() == 9, 5).when(lost, 6).when(made, 3).otherwise(7)
    )


def reciprocal(kind: str) -> tuple[Column, Column]:
    """The two opposite categories of ``ecology`` or ``water``."""
    if kind == "ecology":
        first, second = (old() == 9) | (old() == 5) & (new() != 9), (new() == 9) | (new() == 5) & (old() != 9)
    else:
        first, second = (new() == 8) | (new() == 7) & (old() != 8), (old() == 8) | (old() == 7) & (new() != 8)
    return changed() & first, changed() & second


def reciprocal_category(kind: str) -> Column:
    """0 unchanged, 1 or 2 for the opposite categories, 3 other change; a pixel in both raises."""
    first, second = reciprocal(kind)
    clash = F.raise_error(F.lit("a pixel is in both categories")).cast("int")
    return F.when(~valid(), F.lit(None)).when(old() == new(), 0).when(first & second, clash).when(first, 1).when(second, 2).otherwise(3)


def scoped(pixels: DataFrame, aggs: list[Column], by: list[str] = ()) -> DataFrame:
    """Aggregates overall and per zone in one pass; scope is the zone or 'all'."""
    keys = [F.col(c) for c in by]
    sets = [[*keys], [*keys, F.col("zone")]]
    return pixels.groupingSets(sets, *keys, F.col("zone")).agg(*aggs, F.grouping("zone").alias("_g")).withColumn("scope", F.when(F.col("_g") == 1, "all").otherwise(F.col("zone"))).drop("_g", "zone")


def skeleton(scopes: DataFrame, *columns: tuple[str, int]) -> DataFrame:
    """Every scope with every value 1..n of the columns: ten classes, so of fixed size per scope."""
    out = scopes
    for name, n in columns:
        out = out.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))
    return out


def transition_matrix(pixels: DataFrame) -> DataFrame:
    """Pixels per scope and pair of classes, zero-filled, with a changed flag."""
    n = scoped(pixels.filter(valid()), [F.count("*").alias("n")], ["c1", "c2"])
    scopes = scoped(pixels, [F.count("*").alias("_n")]).select("scope")
    full = skeleton(scopes, ("c1", 10), ("c2", 10)).join(n, ["scope", "c1", "c2"], "left")
    return full.select("scope", "c1", "c2", F.coalesce("n", F.lit(0)).alias("n"), (old() != new()).alias("changed"))


def transition_shares(pixels: DataFrame) -> DataFrame:
    """The matrix with percent of its scope, of the first and of the second class."""

    def share(*by: str) -> Column:
        return F.coalesce(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(*by))), F.lit(0.0))

    m = transition_matrix(pixels)
    return m.select("*", share("scope").alias("pct_scope"), share("scope", "c1").alias("pct_from"), share("scope", "c2").alias("pct_to"), class_name("c1").alias("from_name"), class_name("c2").alias("to_name"))


def class_areas(pixels: DataFrame, pixel_m2: float = 100.0) -> DataFrame:
    """Pixels and area per scope, year and class, zero-filled."""
    long = pixels.select("zone", F.explode(F.array(F.struct(F.lit(2017).alias("year"), old().alias("class_id")), F.struct(F.lit(2024).alias("year"), new().alias("class_id")))).alias("x")).select("zone", "x.*")
    n = scoped(long.filter(F.col("class_id").between(1, 10)), [F.count("*").alias("n")], ["year", "class_id"])
    years = scoped(long, [F.count("*").alias("_n")], ["year"]).select("scope", "year")
    full = skeleton(years, ("class_id", 10)).join(n, ["scope", "year", "class_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("scope", "year", "class_id", "n", (F.col("n") * pixel_m2).alias("area_m2"), (F.col("n") * pixel_m2 / 1e6).alias("area_km2"))


def change_summary(pixels: DataFrame, pixel_m2: float = 100.0) -> DataFrame:
    """Valid, changed and unchanged pixels and areas per scope, and the changed share."""
    s = scoped(pixels, [F.count_if(valid()).alias("valid"), F.count_if(changed()).alias("changed")])
    return s.select("scope", "valid", "changed", (F.col("valid") - F.col("changed")).alias("unchanged"), (F.col("changed") * pixel_m2 / 1e6).alias("changed_km2"), (F.col("valid") * pixel_m2 / 1e6).alias("valid_km2"), F.coalesce(F.try_divide("changed", "valid"), F.lit(0.0)).alias("fraction"))


def uncertainty_summary(pixels: DataFrame) -> DataFrame:
    """Mean uncertainties per scope, of each year, both, and of changed and unchanged pixels."""
    p = pairwise_uncertainty(pixels)
    parts = {"u1": (valid(), "u1"), "u2": (valid(), "u2"), "pair_mean": (valid(), "u_mean"), "pair_max": (valid(), "u_max"), "changed": (changed(), "u_mean"), "unchanged": (valid() & (old() == new()), "u_mean")}
    aggs = [f(F.when(w, F.col(c))).alias(f"{n}_{k}") for k, (w, c) in parts.items() for n, f in (("avg", F.avg), ("n", F.count))]
    return scoped(p, aggs)


def focus_statistics(pixels: DataFrame, pixel_m2: float = 100.0) -> DataFrame:
    """Unchanged, focus and other pixels per scope and focus map, with shares."""
    codes = F.array(*(F.struct(F.lit(k).alias("map_key"), display_code(f).alias("class_id")) for k, f in focus_flags().items()))
    long = pixels.select("zone", F.explode(codes).alias("x")).select("zone", "x.*").filter("class_id is not null")
    n = scoped(long, [F.count("*").alias("n")], ["map_key", "class_id"])
    scopes = scoped(pixels, [F.count("*").alias("_n")]).select("scope")
    full = scopes.withColumn("map_key", F.explode(F.array(*map(F.lit, FOCUS)))).withColumn("class_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    full = full.join(n, ["scope", "map_key", "class_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("scope", "map_key")
    total, moved = F.sum("n").over(w), F.sum(F.when(F.col("class_id") > 0, F.col("n")).otherwise(0)).over(w)
    pct = F.when(F.col("class_id") > 0, F.coalesce(F.try_divide(F.col("n") * 100.0, moved), F.lit(0.0))).otherwise(0.0)
    return full.select("scope", "map_key", "class_id", "n", (F.col("n") * pixel_m2 / 1e6).alias("area_km2"), F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)).alias("pct_valid"), pct.alias("pct_changed"), total.alias("valid"), moved.alias("changed"))


def focus_totals(pixels: DataFrame, pixel_m2: float = 100.0) -> DataFrame:
    """The focus rows of all maps, rounded, and a row of their totals."""
    rows = focus_statistics(pixels, pixel_m2).filter("scope = 'all' and class_id = 1")
    rows = rows.select("map_key", *(F.round(c, 4).alias(c) for c in ("area_km2", "pct_valid", "pct_changed")), F.round(F.col("valid") * pixel_m2 / 1e6, 4).alias("valid_km2"))
    total = rows.agg(F.lit("TOTAL").alias("map_key"), *(F.round(F.sum(c), 4).alias(c) for c in ("area_km2", "pct_valid", "pct_changed")), F.max("valid_km2").alias("valid_km2"))
    return rows.unionByName(total)


def group_statistics(pixels: DataFrame) -> DataFrame:
    """Pixels per scope and exclusive group, with the share of the scope."""
    n = scoped(pixels.withColumn("grp", change_group()).filter("grp is not null"), [F.count("*").alias("n")], ["grp"])
    return n.select("scope", "grp", "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("scope"))).alias("pct"))


def reciprocal_statistics(pixels: DataFrame, kind: str) -> DataFrame:
    """A10: pixels per scope and category, their net balance, and detail per pair of classes.

    row_type is category (pairs null), net (second less first category) or transition.
    """
    p = pixels.withColumn("category", reciprocal_category(kind)).filter("category is not null")
    detail = scoped(p, [F.count("*").alias("n")], ["category", "c1", "c2"]).withColumn("row_type", F.lit("transition"))
    none = F.lit(None).cast("int")
    cats = detail.groupBy("scope", "category").agg(F.sum("n").alias("n")).withColumns({"c1": none, "c2": none, "row_type": F.lit("category")})
    net = cats.groupBy("scope").agg(F.sum(F.when(F.col("category") == 2, F.col("n")).when(F.col("category") == 1, -F.col("n")).otherwise(0)).alias("n")).withColumns({"category": none, "c1": none, "c2": none, "row_type": F.lit("net")})
    out = reduce(DataFrame.unionByName, [cats, net, detail.filter("category in (1, 2)")])
    return out.select("scope", "row_type", "category", "c1", "c2", "n")


def code_counts(pixels: DataFrame) -> DataFrame:
    """Pixels per transition code."""
    return pixels.filter(valid()).groupBy((old() * 100 + new()).alias("code")).agg(F.count("*").alias("n"))


def top_changes(pixels: DataFrame, n: int) -> DataFrame:
    """The ``n`` most common codes of a change, the lower code first on ties."""
    return code_counts(pixels).filter("code div 100 <> code % 100").orderBy(F.desc("n"), "code").limit(n)


def preview_class(pixels: DataFrame, n: int = 9) -> DataFrame:
    """0 unchanged, 1 other change, else 1 + rank of a top code."""
    top = top_changes(pixels, n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "code"))).select("code", "rank")  # n rows
    out = pixels.filter(valid()).withColumn("code", old() * 100 + new()).join(F.broadcast(top), "code", "left")
    return out.withColumn("preview", F.when(old() == new(), 0).when(F.col("rank").isNull(), 1).otherwise(F.col("rank") + 1)).drop("rank")


def window_counts(pixels: DataFrame, size: int) -> DataFrame:
    """Valid and changed pixels of each window of ``size`` rows."""
    return pixels.groupBy(F.floor(F.col("px_row") / size).alias("win")).agg(F.count_if(valid()).alias("valid"), F.count_if(changed()).alias("changed"))


def changed_windows(pixels: DataFrame, size: int, n: int, seed: int, used: DataFrame | None = None) -> DataFrame:
    """``n`` windows with a changed pixel in random but repeatable order.

    Windows in ``used`` are left out; windows with valid pixels only follow
    when there are too few.
    """
    w = window_counts(pixels, size).filter("valid > 0")
    if used is not None:
        w = w.join(used, "win", "left_anti")
    return w.orderBy(F.col("changed") == 0, mixed(seed, F.col("win")), "win").limit(n)
