"""Classes of places by type lists, keywords and boxes, as Column expressions. All return null for null input where not said otherwise."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: type vocabularies of the two classes that are compared
MONUMENTAL = (
    "pyramid", "temple", "temple-2", "sanctuary", "monument", "architecturalcomplex", "tomb", "church", "church-2", "amphitheatre", "hippodrome", "aqueduct", "dam", "lighthouse", "arch", "theatre", "basilica", "acropolis", "nuraghe", "tumulus", "shrine",
)
SETTLEMENT = (
    "settlement", "settlement-modern", "village", "villa", "farmstead", "station", "findspot", "port", "mine", "mine-2", "quarry", "bath", "cistern", "bridge", "fortified-settlement", "townhouse", "production",
)
# fixed values: words in names of the two classes of dated sites, the first class goes before the second
MONUMENTAL_WORDS = (
    "temple", "pyramid", "tomb", "mound", "monument", "cairn", "megalith", "henge", "huaca", "ceremonial", "ritual", "geoglyph", "ahu", "moai", "stela", "ziggurat", "palace", "citadel", "fortress", "dolmen", "stone circle", "standing stone", "barrow", "tumulus", "sanctuary", "necropolis", "acropolis", "amphitheatre", "colosseum",
)
DOMESTIC_WORDS = (
    "village", "settlement", "farm", "camp", "midden", "shell mound", "quarry", "mine", "shelter", "rockshelter", "workshop", "kiln", "pit", "habitation", "dwelling", "house", "homestead", "terrace", "field", "granary", "storehouse", "well", "cistern", "fishweir",
)
# fixed values: types of three uses that a place may have at once
USES = (
    ("mortuary", ("tomb", "tumulus", "necropolis", "mausoleum", "pyramid", "mastaba", "catacomb", "cemetery", "burial")),
    ("ceremonial", ("temple", "sanctuary", "shrine", "altar", "church", "monastery", "synagogue", "sacred-grove", "temple-2", "church-2")),
    ("administrative", ("palace", "fortress", "fort", "castle", "wall", "aqueduct", "bridge", "bath", "theater", "amphitheater", "arch", "hippodrome", "stadium", "forum", "amphitheatre", "theatre")),
)
# fixed values: types of another gazetteer
ATLAS_TYPES = (
    ("monumental", ("temple", "amphitheater", "theatre", "odeon", "stadium", "circus", "monument", "necropolis", "tumulus", "aqueduct/dam/cistern/spring", "basilica", "forum", "bath", "lighthouse", "bouleuterion")),
    ("settlement", ("city", "town", "civitas", "villa", "settlement", "Late-Roman oppidum", "Iron-Age oppidum", "oasis")),
    ("military", ("fort", "fortress", "camp", "fortlet/tower", "wall")),
    ("infrastructure", ("station", "bridge", "port", "road/milestone", "mine/quarry", "production", "well")),
)
# fixed values: boxes of regions (south, north, west, east), tested in this order
REGIONS = (
    ("Egypt/Levant", 25.0, 35.0, 25.0, 40.0), ("Iran/Central Asia", 25.0, 40.0, 40.0, 65.0), ("South Asia", 5.0, 35.0, 65.0, 95.0), ("SE Asia", -15.0, 25.0, 95.0, 140.0),
    ("Pacific/Oceania", -50.0, 25.0, 140.0, 180.0), ("Peru/Amazon", -20.0, 5.0, -85.0, -65.0), ("North Africa/Mediterranean", 15.0, 35.0, -20.0, 25.0), ("Sub-Saharan Africa", -10.0, 15.0, -20.0, 45.0),
)
# fixed values: types of an added list that are old whatever their date, and those that are late
OLD_TYPES = ("pyramid", "temple", "geoglyph", "megalith", "stone_circle", "rock_art", "dolmen", "burial", "earthwork", "mound", "observatory", "ziggurat", "rock_cut_city", "trilithon", "jar_burial", "shrine", "rock", "aqueducts", "terraces")
LATE_TYPES = ("fortress", "stela", "palace", "tower", "tomb", "rock_cut")
# fixed values: periods of one valley, half-open, tested in this order
VALLEY_PERIODS = (
    ("Badarian", -4400, -4000), ("Naqada I", -4000, -3500), ("Naqada II", -3500, -3200), ("Naqada III", -3200, -3000), ("Early Dynastic", -3100, -2686), ("Old Kingdom", -2686, -2181), ("Pre-Badarian", None, -4400), ("Post-OK", -2181, None),
)


def type_set(text) -> Column:
    """Comma list to an array of trimmed, lower-case tokens."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(F.lower(t), ","), lambda x: F.trim(x))


def set_class(types: Column, first: Sequence[str] = MONUMENTAL, second: Sequence[str] = SETTLEMENT, both: bool = False) -> Column:
    """monument, settlement, both (else monument wins) or other."""
    a, b = (F.arrays_overlap(types, F.array(*map(F.lit, words))) for words in (first, second))
    out = F.when(a & b, F.lit("both")) if both else F.when(a, F.lit("monument"))
    return out.when(a, F.lit("monument")).when(b, F.lit("settlement")).otherwise(F.lit("other"))


def keyword_class(text, cascade: Sequence[tuple[str, Sequence[str]]], other: str = "other") -> Column:
    """The first class of the cascade one of whose words occurs anywhere in the text, in any case."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    out = None
    for name, words in cascade:
        hit = t.rlike("|".join(re.escape(w.lower()) for w in words))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def box_class(lat, lon, boxes: Sequence[tuple[str, float, float, float, float]], other: str = "Other") -> Column:
    """The first box (name, south, north, west, east; closed) that holds the point."""
    la, lo = (F.col(v) if isinstance(v, str) else v for v in (lat, lon))
    out = None
    for name, south, north, west, east in boxes:
        hit = la.between(south, north) & lo.between(west, east)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def zone(distance, near: float = 50.0, far: float = 200.0) -> Column:
    """on within near km, off beyond far km, null in between."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.when(d < near, F.lit("on")).when(d > far, F.lit("off"))


def grid_cell(lat, lon, degrees: float) -> tuple[Column, Column]:
    la, lo = (F.col(v) if isinstance(v, str) else v for v in (lat, lon))
    return F.floor(la / degrees) * F.lit(degrees), F.floor(lo / degrees) * F.lit(degrees)


def multi_label(types: Column, labels: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """All labels of which the types hold a word, in the order given."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(types, F.array(*map(F.lit, words))), F.lit(name)) for name, words in labels]))


def flags(types: Column, first: Sequence[str] = MONUMENTAL, second: Sequence[str] = SETTLEMENT) -> tuple[Column, Column]:
    """Both classes as they are: a place may be in either, both or none."""
    return F.arrays_overlap(types, F.array(*map(F.lit, first))), F.arrays_overlap(types, F.array(*map(F.lit, second)))


def period(year, table: Sequence[tuple[str, float | None, float | None]], other: str = "other") -> Column:
    """The first half-open range [start, end) that holds the year; None is an open end."""
    y = F.col(year) if isinstance(year, str) else year
    out = None
    for name, start, end in table:
        hit = (y >= start if start is not None else F.lit(True)) & (y < end if end is not None else F.lit(True)) & y.isNotNull()
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


# fixed values: clusters in the order in which they are tested: centre and radius in km, or box (south, north, west, east)
CLUSTERS = (
    ("Easter Island", (-27.1, -109.3, 200.0)), ("Egypt / Levant", (20.0, 36.0, 25.0, 40.0)), ("Peru / Andes", (-25.0, 0.0, -80.0, -60.0)), ("Iran / Persia", (25.0, 38.0, 44.0, 60.0)), ("Indus Valley", (20.0, 35.0, 60.0, 80.0)), ("Southeast Asia", (0.0, 25.0, 95.0, 115.0)),
)


def cluster(lat, lon, clusters: Sequence[tuple[str, tuple]] = CLUSTERS, other: str = "Other") -> Column:
    """The first cluster that holds a point: nearer than the radius to a centre, or in a closed box."""
    from arcspan.functions.geo import haversine_km

    la, lo = (F.col(v) if isinstance(v, str) else v for v in (lat, lon))
    out = None
    for name, shape in clusters:
        hit = haversine_km(lat, lon, *shape[:2]) < shape[2] if len(shape) == 3 else la.between(*shape[:2]) & lo.between(*shape[2:])
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def offset_bin(lon, reference: float, width: float) -> Column:
    """Bin of the longitude east of a reference, 0 to 360."""
    o = F.col(lon) if isinstance(lon, str) else lon
    return F.floor(F.pmod(o - reference, F.lit(360.0)) / width) * width


def member_class(kind, sets: Sequence[tuple[str, Sequence[str]]] = ATLAS_TYPES, other: str = "other") -> Column:
    """The first set that holds a type, letter for letter."""
    t = F.col(kind) if isinstance(kind, str) else kind
    out = None
    for name, words in sets:
        hit = F.coalesce(t.isin(*words), F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def era_class(kind, year) -> Column:
    """prehistoric or later by type, where that leaves it open by signed year: a citadel is later after 500, a settlement or city after -500."""
    t, y = (F.col(v) if isinstance(v, str) else v for v in (kind, year))
    dated = F.coalesce(y, F.lit(0)) != 0
    return (
        F.when(t.isin(*OLD_TYPES), "prehistoric").when(t.isin(*LATE_TYPES), "later")
        .when(t == "citadel", F.when(dated & (y > 500), "later").otherwise("prehistoric"))
        .when(t.isin("settlement", "city"), F.when(y.isNull() | (y < -500), "prehistoric").otherwise("later"))
        .otherwise("prehistoric")
    )


def stage(subtype, bp) -> Column:
    """Stage 1 to 6 of a hollow by its subtype and age; null for other subtypes."""
    t, age = (F.col(v) if isinstance(v, str) else v for v in (subtype, bp))
    cave = F.when((age >= 5000) & (age < 10000), 3).otherwise(1)
    modified = F.when((age >= 5000) & (age < 10000), 3).otherwise(2)
    cut = F.when(age >= 3000, 4).otherwise(5)
    return F.when(t == "natural_cave", cave).when(t == "modified_cave", modified).when(t == "rock_cut_monumental", cut).when(t == "artificial_complex", 6)
