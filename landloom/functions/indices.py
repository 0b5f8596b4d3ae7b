"""Spectral indices of optical bands; a nodata band or an undefined quotient gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digital number of a missing value, and reflectance of one step.
NODATA, SCALE = 65535, 0.0001
INDEX_NAMES = ["ndvi", "evi", "msavi", "ndmi", "ndwi", "ndpi", "ndbi", "bsi", "nirv", "awei_sh"]


def dn(band: str) -> Column:
    """Digital number as a double, null for nodata."""
    return F.nullif(F.col(band), F.lit(NODATA)).cast("double")


def reflectance(band: str) -> Column:
    return dn(band) * SCALE


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def ndvi(red: str, nir: str) -> Column:
    """P01"""
    return normalised_difference(dn(nir), dn(red))


def evi(blue: str, red: str, nir: str) -> Column:
    """Null for reflectances outside 0..2, denominators up to 1e-6, and results outside -2..2."""
    b, r, n = map(reflectance, (blue, red, nir))
    bottom = n + 6.0 * r - 7.5 * b + 1.0
    sound = reduce(Column.__and__, (x.between(0, 2) for x in (b, r, n))) & (bottom > 1e-6)
    value = F.when(sound, F.try_divide(2.5 * (n - r), bottom))
    return F.when(value.between(-2, 2), value)


def msavi(red: str, nir: str) -> Column:
    """P03"""
    r, n = reflectance(red), reflectance(nir)
    t = 2.0 * n + 1.0
    square = t * t - 8.0 * (n - r)
    return F.when(square.isNotNull(), (t - F.sqrt(F.greatest(square, F.lit(0.0)))) / 2.0)


def ndmi(nir: str, swir: str) -> Column:
    """P04"""
    return normalised_difference(dn(nir), dn(swir))


def ndwi(green: str, nir: str) -> Column:
    """P05"""
    return normalised_difference(dn(green), dn(nir))


def ndpi(green: str, swir: str) -> Column:
    """P06"""
    return normalised_difference(dn(swir), dn(green))


def ndbi(nir: str, swir: str) -> Column:
    """P07"""
    return normalised_difference(dn(swir), dn(nir))


def bsi(blue: str, red: str, nir: str, swir: str) -> Column:
    """P08"""
    return normalised_difference(dn(swir) + dn(red), dn(nir) + dn(blue))


def nirv(red: str, nir: str) -> Column:
    """P09"""
    return ndvi(red, nir) * reflectance(nir)


def awei_sh(blue: str, green: str, nir: str, swir1: str, swir2: str) -> Column:
    """P10"""
    b, g, n, s1, s2 = map(reflectance, (blue, green, nir, swir1, swir2))
    return b + 2.5 * g - 1.5 * (n + s1) - 0.25 * s2


def all_indices() -> dict[str, Column]:
    """The ten indices in their fixed order, of bands b2, b3, b4, b8, b11 and b12."""
    return dict(
        zip(
            INDEX_NAMES,
            (ndvi("b4", "b8"), evi("b2", "b4", "b8"), msavi("b4", "b8"), ndmi("b8", "b11"), ndwi("b3", "b8"), ndpi("b3", "b11"), ndbi("b8", "b11"), bsi("b2", "b4", "b8", "b11"), nirv("b4", "b8"), awei_sh("b2", "b3", "b8", "b11", "b12")),
            strict=True,
        )
    )

#: Number of each index's operator.
INDEX_NAMES_TO_IDS = {name: f"{k:02d}" for k, name in enumerate(INDEX_NAMES, start=1)}
