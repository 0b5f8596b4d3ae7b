"""Parcels and their land cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority(pixels: DataFrame, parcels: DataFrame, key: str) -> DataFrame:
    """Commonest class per parcel, the smaller on ties, with its pixels, all valid ones and its share; 0 for none."""
    n = pixels.filter(F.col("class_id").between(1, 10)).groupBy(key, "class_id").agg(F.count("*").alias("n"))
    top = n.groupBy(key).agg(F.max_by("class_id", F.struct("n", -F.col("class_id"))).alias("class_id"), F.max("n").alias("major_px"), F.sum("n").alias("valid_px"))
    out = parcels.select(key).join(top, key, "left").na.fill(0, ["class_id", "major_px", "valid_px"])
    return out.withColumn("major_frac", F.coalesce(F.try_divide("major_px", "valid_px"), F.lit(0.0)))


def parcel_change(parcels: DataFrame, key: str, year1: int, year2: int) -> DataFrame:
    """A parcel's class of two years in one row; a key that a year has twice raises.  P36: derived fields."""
    sides = []
    for k, year in ((1, year1), (2, year2)):
        side = parcels.filter(F.col("year") == year).groupBy(key).agg(F.count("*").alias("_k"), F.first("class_id").alias(f"class_{k}"), F.first("area_m2").alias(f"area_{k}"))
        sides.append(side.withColumn(f"class_{k}", F.when(F.col("_k") == 1, F.col(f"class_{k}")).otherwise(F.raise_error(F.lit("parcel key is not unique")).cast("long"))).drop("_k"))
    both = sides[0].join(sides[1], key)
    return both.withColumns({"changed": F.col("class_1") != F.col("class_2"), "code": F.concat_ws("_", "class_1", "class_2"), "label": F.concat_ws(" -> ", "class_1", "class_2"), "area_diff": F.col("area_2") - F.col("area_1")})


def key_quality(one: DataFrame, two: DataFrame, candidates: list[str]) -> DataFrame:
    """Per candidate key and layer, rows, distinct values and nulls; a key is usable if unique and never null in both."""
    def measure(df: DataFrame, layer: str) -> DataFrame:
        aggs = [x for c in candidates for x in (F.count_distinct(c).alias(f"{c}_d"), F.count_if(F.col(c).isNull()).alias(f"{c}_n"))]
        row = df.agg(F.count("*").alias("n"), *aggs)
        return row.select(F.lit(layer).alias("layer"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"{c}_d").alias("distinct_values"), F.col(f"{c}_n").alias("nulls")) for c in candidates))).alias("x")).select("layer", "x.*")

    both = measure(one, "first").unionByName(measure(two, "second"))
    good = (F.col("rows") == F.col("distinct_values")) & (F.col("nulls") == 0)
    return both.groupBy("column").agg(F.sum("rows").alias("rows"), F.bool_and(good).alias("usable"))


def choose_key(one: DataFrame, two: DataFrame, candidates: list[str], geometry: str) -> str:
    """The first usable candidate, else the geometry's fingerprint."""
    usable = {r["column"] for r in key_quality(one, two, candidates).filter("usable").collect()}
    return next((c for c in candidates if c in usable), geometry)


def collapsed(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows with the second column of each pair dropped if it agrees with the first on every row."""
    same = rows.agg(*(F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(b) for a, b in pairs)).first()
    return rows.drop(*(b for _, b in pairs if same[b] is not False))


def cleaned(parcels: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Parcels with a positive area; unknown kinds named, two kinds renamed."""
    kept = parcels.filter(F.col("area_m2") > 0).withColumn("kind", F.coalesce("kind", F.lit("Unknown")))
    return kept.replace(renames, subset=["kind"])


def area_by(parcels: DataFrame, keys: list[str]) -> DataFrame:
    """Area and number of parcels per group."""
    return parcels.groupBy(*keys).agg(F.sum("area_m2").alias("area_m2"), F.count("*").alias("n"))


def top_kinds(parcels: DataFrame, n: int) -> DataFrame:
    """The ``n`` kinds of parcel with most area, the first name on ties."""
    return area_by(parcels, ["kind"]).orderBy(F.desc("area_m2"), "kind").limit(n)


def kind_profile(parcels: DataFrame, n: int) -> DataFrame:
    """Area per class of the top kinds, with the place of each kind."""
    top = top_kinds(parcels, n)
    ranked = top.select("kind", F.row_number().over(Window.orderBy(F.desc("area_m2"), "kind")).alias("place"))  # n rows
    return area_by(parcels.join(F.broadcast(ranked), "kind"), ["place", "kind", "class_id"])


def use_frequency(landuse: DataFrame) -> DataFrame:
    """Frequency of each pair of major and sub use, with percent of the major use."""
    n = landuse.groupBy("maj", "sub").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("maj")), 2))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value of the columns occurs."""
    long = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(long).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def zone_areas(pixels: DataFrame, pixel_m2: float) -> DataFrame:
    """Pixels, area and percent of the zone per zone and class."""
    n = pixels.groupBy("zone", "class_id").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("zone"))
    return n.withColumns({"area_ha": F.col("n") * pixel_m2 / 1e4, "pct_zone": F.col("n") * 100.0 / total, "zone_n": total})
