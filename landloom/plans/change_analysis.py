"""Change analysis end to end: two years of classes with zones to all report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landloom.operators import change as C
from landloom.sources.derived import table


def reports(pixels: DataFrame, pixel_m2: float = 100.0) -> dict[str, DataFrame]:
    """Every table of a change analysis of pixels (zone, c1, c2, u1, u2); each is lazy."""
    return {
        "class_areas": C.class_areas(pixels, pixel_m2),
        "change_summary": C.change_summary(pixels, pixel_m2),
        "transitions": C.transition_shares(pixels),
        "uncertainty": C.uncertainty_summary(pixels),
        "focus": C.focus_statistics(pixels, pixel_m2),
        "focus_totals": C.focus_totals(pixels, pixel_m2),
        "groups": C.group_statistics(pixels),
        "ecology": C.reciprocal_statistics(pixels, "ecology"),
        "water": C.reciprocal_statistics(pixels, "water"),
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition matrix with shares per zone, of the class pairs derived from ``lineitem``."""
    return reports(table(spark, sf_dir, "class_pair"))["transitions"]
