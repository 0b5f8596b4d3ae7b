"""Classes, names and codes of land cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ten classes.
CLASS_NAMES = {
    1: "Urban / Institutional Built-up",
    2: "Rural Settlement (Homestead Vegetation)",
    3: "Transport & Coastal Embankments",
    4: "Cropland (All Crop Intensities)",
    5: "Tree-based Agroforestry & Orchard",
    6: "Aquaculture & Inland Ponds",
    7: "Canals & Drainage Network",
    8: "Rivers & Estuarine Channels",
    9: "Mangrove Forest",
    10: "Bare / Exposed Coastal Land",
}
# Classes of three other legends in terms of the ten classes.
DYNAMICWORLD = {0: 8, 1: 5, 2: 2, 3: 9, 4: 4, 5: 5, 6: 1, 7: 10, 8: 10}
JAXA = {1: 8, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 9, 8: 2, 9: 5, 10: 5, 11: 5, 12: 5, 13: 5, 14: 9, 15: 10}
HIGH_RESOLUTION = {1: 8, 2: 1, 3: 4, 4: 4, 5: 6, 6: 5, 7: 1, 8: 5, 9: 9, 10: 10, 11: 5, 12: 4, 13: 10, 14: 5}
# Display names by alias.
FAMILIES = {"cnn1d": "CNN1D", "fttransformer": "FTTransformer", "lightgbm": "LightGBM", "lgbm": "LightGBM", "mlp": "MLP", "resmlp": "ResMLP", "xgboost": "XGBoost", "xgb": "XGBoost"}
FEATURE_SETS = {"ae64": "AE64", "ae64_plus10indices": "AE64_plus10indices"}
ZONES = {"western": "Western Zone", "central": "Central Zone", "eastern": "Eastern Zone"}
FAMILY_ORDER = ["CNN1D", "FTTransformer", "LightGBM", "MLP", "ResMLP", "XGBoost"]


def lookup(values: dict, key) -> Column:
    """Value of a small fixed dictionary, null where it has none.  (F20, J15)"""
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def class_name(class_id) -> Column:
    """Name of a class."""
    return lookup(CLASS_NAMES, F.col(class_id) if isinstance(class_id, str) else class_id)


def harmonised(code, legend: dict[int, int]) -> Column:
    """Class of another legend's code; unmapped and null give 0."""
    return F.coalesce(lookup(legend, F.col(code)), F.lit(0))


def normalised(text) -> Column:
    """trimmed, lower case, runs of white space as one space; null is empty."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " "))), F.lit(""))


def safe_stem(text) -> Column:
    """characters unfit for a file name become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.col(text), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def family_name(text) -> Column:
    """display name of a model family, else the text itself."""
    key = F.translate(F.trim(F.lower(F.col(text))), "-_", "")
    return F.coalesce(lookup(FAMILIES, key), F.col(text))


def feature_set_name(text) -> Column:
    """display name of a feature set, else the text itself."""
    return F.coalesce(lookup(FEATURE_SETS, F.trim(F.lower(F.col(text)))), F.col(text))


def family_of_group(group, kind=None) -> Column:
    """family from a model type's beginning, else from a group's."""
    families = ["fttransformer", "resmlp", "mlp", "cnn1d", "lgbm", "xgboost"]
    out = F.lit("")
    prefixes = [("fttransformer_", "fttransformer"), ("ftt_", "fttransformer"), *((f"{f}_", f) for f in families[1:]), ("xgb_", "xgboost")]
    for prefix, family in reversed(prefixes):
        out = F.when(F.col(group).startswith(prefix), family).otherwise(out)
    if kind:
        for family in reversed(families):
            out = F.when(F.col(kind).startswith(family), family).otherwise(out)
    return out


def feature_set_of_group(group) -> Column:
    """feature set from a group's name."""
    return F.when(F.col(group).contains("plus10idx"), "ae64_plus10indices").otherwise("ae64")


def last_part(path) -> Column:
    """last part of a path."""
    return F.element_at(F.split(F.regexp_replace(F.col(path), "/+$", ""), "/"), -1)


def seeded_name(family, feature_set, seed) -> Column:
    """name of a run with a seed."""
    return F.format_string("final10seed_%s_%s_seed%03d", F.col(family), F.col(feature_set), F.col(seed))


def band_name(band) -> Column:
    """band name without zeros in front of its number."""
    return F.regexp_replace(F.col(band), "^B0*([0-9]+)$", "B$1")


def zone_name(key) -> Column:
    """display name of a zone, else its words with capitals."""
    return F.coalesce(lookup(ZONES, F.col(key)), F.initcap(F.col(key)))


def block_name(area, row, col) -> Column:
    """Name of a spatial block."""
    return F.format_string("%s:r%04d_c%04d", F.col(area).cast("string"), F.col(row), F.col(col))


def hemisphere(value, kind: str) -> Column:
    plus, minus = ("E", "W") if kind == "lon" else ("N", "S")
    return F.when(F.col(value) >= 0, plus).otherwise(minus)


def degree_minute(value, kind: str) -> Column:
    """degrees and whole minutes, with a carry at 60."""
    total = F.rint(F.abs(F.col(value)) % 1 * 60).cast("int")
    degrees = F.floor(F.abs(F.col(value))).cast("int") + F.when(total == 60, 1).otherwise(0)
    return F.concat(F.format_string("%d°%02d′", degrees, total % 60), hemisphere(value, kind))


def degree_minute_second(value, kind: str) -> Column:
    """degrees, minutes and whole seconds, with carries at 60."""
    part = F.abs(F.col(value)) % 1 * 60
    second = F.rint(part % 1 * 60).cast("int")
    minute = F.floor(part).cast("int") + F.when(second == 60, 1).otherwise(0)
    degrees = F.floor(F.abs(F.col(value))).cast("int") + F.when(minute == 60, 1).otherwise(0)
    return F.concat(F.format_string("%d°%02d′%02d″", degrees, minute % 60, second % 60), hemisphere(value, kind))


def degree_minute_hundredths(value, kind: str) -> Column:
    """degrees and minutes with two decimals."""
    return F.concat(F.format_string("%d°%05.2f' ", F.floor(F.abs(F.col(value))).cast("int"), F.abs(F.col(value)) % 1 * 60), hemisphere(value, kind))


def transition_code(c1, c2) -> Column:
    """Code of a change from one class to another."""
    return F.col(c1) * 100 + F.col(c2)


def safe_divide(a, b, missing=0.0) -> Column:
    """F14 with ``missing`` 0, F15 with None: a quotient, or ``missing`` if it is undefined."""
    q = F.try_divide(a, b)
    return q if missing is None else F.coalesce(q, F.lit(missing))


def number_or_infinity(text, negative: bool = False) -> Column:
    """F16: a number, or infinity if the text is none."""
    return F.coalesce(F.expr(f"try_cast({text} as double)"), F.lit(float("-inf" if negative else "inf")))


def softmax(values) -> Column:
    """stable softmax of an array."""
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(values) -> Column:
    """Place, from 1, of the first largest element."""
    return F.array_position(values, F.array_max(values)).cast("int")


def joined_list(columns: list[str], separator: str) -> Column:
    """values of columns as text, joined."""
    return F.array_join(F.array(*(F.col(c).cast("string") for c in columns)), separator)
