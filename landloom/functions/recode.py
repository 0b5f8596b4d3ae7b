"""Land-use texts as one of the ten classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions.names import lookup, normalised

# Class of a major land use alone.
MAJOR = {
    "administrative area": 1,
    "commercial area": 1,
    "educational institutions": 1,
    "industrial area": 1,
    "religious places": 1,
    "recreational places": 1,
    "monument": 1,
    "terminal": 1,
    "road": 3,
    "agricultural land": 4,
    "forest": 9,
    "miscellaneous landuse": 10,
    "water bodies": 6,
    "settlement": 2,
}
# Class of a major and a sub use together.
PAIRS = {
    ("settlement", "rural settlement with homestead vegetation"): 2,
    ("settlement", "urban built-up area"): 1,
    ("settlement", "area under development"): 1,
    ("settlement", "open space"): 1,
    ("road", "rural road"): 3,
    ("road", "upazila road"): 3,
    ("road", "zila road"): 3,
    ("road", "regional road"): 3,
    ("road", "access road"): 3,
    ("road", "right of way"): 3,
    ("road", "embankment cum road"): 3,
    ("road", "bridge"): 3,
    ("agricultural land", "single crop land"): 4,
    ("agricultural land", "double crop land"): 4,
    ("agricultural land", "triple crop land"): 4,
    ("agricultural land", "cultivable fallow land"): 4,
    ("agricultural land", "agroforestry"): 5,
    ("agricultural land", "orchard"): 5,
    ("agricultural land", "betel leaf trellis"): 5,
    ("agricultural land", "rice-cum-fish culture"): 6,
    ("water bodies", "pond"): 6,
    ("water bodies", "aquaculture"): 6,
    ("water bodies", "ditch"): 7,
    ("water bodies", "canal"): 7,
    ("water bodies", "river"): 8,
    ("forest", "mangrove plantation"): 9,
    ("miscellaneous landuse", "mudflat"): 10,
    ("miscellaneous landuse", "sandbar/beach"): 10,
    ("miscellaneous landuse", "non-cultivable fallow land"): 10,
    ("miscellaneous landuse", "grass land"): 10,
    ("commercial area", "commercial area"): 1,
    ("commercial area", "brick field"): 1,
    ("commercial area", "gas field/power station"): 1,
    ("commercial area", "extraction/dumping/mining site"): 1,
    ("commercial area", "filling station"): 1,
    ("educational institutions", "school/college/madrasha"): 1,
    ("educational institutions", "educational institutions"): 1,
    ("administrative area", "office compound"): 1,
    ("industrial area", "rice mill /chatal"): 1,
    ("religious places", "mosque"): 1,
    ("religious places", "temple"): 1,
    ("religious places", "church"): 1,
    ("religious places", "eidgah"): 1,
    ("religious places", "graveyard"): 1,
    ("religious places", "religious places"): 1,
    ("recreational places", "playground"): 1,
    ("monument", "shaheed minar"): 1,
    ("monument", "other monuments"): 1,
    ("terminal", "boat ghat"): 1,
    ("terminal", "ferry ghat"): 1,
    ("terminal", "launch terminal"): 1,
    ("terminal", "helipad"): 1,
}


def recoded(landuse: DataFrame, maj: str = "maj", sub: str = "sub") -> DataFrame:
    """Adds class_id, null if unmapped, and reason, the pair or the major use that decided."""
    m, s = normalised(maj), normalised(sub)
    pair, major = lookup({f"{a}/{b}": c for (a, b), c in PAIRS.items()}, F.concat(m, F.lit("/"), s)), lookup(MAJOR, m)
    by_major = pair.isNull() & major.isNotNull()
    return landuse.withColumns({"class_id": F.coalesce(pair, major), "reason": F.concat(m, F.lit("/"), F.when(by_major, "(maj-default)").otherwise(s))})
