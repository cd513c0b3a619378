"""Quantities written in different units, brought to one unit.

Unit strings are cut by dynamic programming over tries of prefixes, roots, exponents and epoch phrases. A decomposition's
score is the sum of its parts' weights, to which the prior of the field's dimension is added, so that "a" is a year beside
a number in a field of ages, an are in a field of areas and an article in a sentence. Readings in several dimensions that
no prior tells apart are no unit. Years have scales and epochs; other dimensions are brought to their base unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BP, B2K, BCE, CE, CALENDAR = "bp", "b2k", "bce", "ce", "cal"
#: a figure beyond the age of the universe many times over is no quantity of years
MOST_YEARS = Decimal(10) ** 12


@dataclass(frozen=True)
class Entry:
    kind: str
    value: object = None
    weight: float = 1.0


@dataclass(frozen=True)
class Unit:
    """Years times scale, counted from an epoch; a part not stated is None."""

    scale: Decimal | None = None
    epoch: str | None = None

    def code(self) -> str:
        return f"{self.scale or ''}|{self.epoch or ''}"

    @staticmethod
    def of(code: str | None) -> "Unit | None":
        if not code:
            return None
        scale, epoch = code.split("|")
        return Unit(Decimal(scale) if scale else None, epoch or None)


class Trie:
    def __init__(self):
        self.root: dict = {}

    def add(self, text: str, entry: Entry) -> None:
        node = self.root
        for ch in text:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append(entry)

    def walk(self, text: str, at: int) -> Iterator[tuple[int, Entry]]:
        node = self.root
        for j in range(at, len(text)):
            node = node.get(text[j])
            if node is None:
                return
            for entry in node.get("", ()):
                yield j + 1, entry


SYMBOL_PREFIXES = {"k": 3, "M": 6, "G": 9, "c": -2, "m": -3, "µ": -6}
SCALE_WORDS = {
    3: "thousand thousands kilo tausend tausende tausenden millier milliers mil miles migliaia mila millennia millennium jahrtausend jahrtausende jahrtausenden millénaire millénaires milenio milenios millennio",
    6: "million millions millionen millón millones milione milioni",
    2: "century centuries jahrhundert jahrhunderte jahrhunderten siècle siècles siglo siglos secolo secoli",
}
#: roots by dimension
ROOTS = {
    "time": ("a", "y", "ya", "yr", "yrs", "year", "years", "annum", "jahr", "jahre", "jahren", "an", "ans", "année", "années", "año", "años", "anno", "anni"),
    "length": ("m", "metre", "metres", "meter", "meters", "mètre", "mètres", "metro", "metri", "in", "inch", "inches", "ft", "foot", "feet", "yd", "mi", "mile", "miles", "'", "\""),
    "mass": ("g", "gram", "grams", "gramm", "gr", "t", "tonne", "tonnes", "lb", "lbs", "oz"),
    "area": ("ha", "hectare", "hectares", "a", "are", "ares", "ar", "acre", "acres"),
    "volume": ("l", "litre", "litres", "liter", "gal", "gallon"),
}
#: fixed values: size of a root in the base unit of its dimension (year, metre, gram, square metre, cubic metre); 1 if not here
SIZES = {
    ("length", "in"): "0.0254", ("length", "inch"): "0.0254", ("length", "inches"): "0.0254", ("length", "\""): "0.0254", ("length", "ft"): "0.3048", ("length", "foot"): "0.3048", ("length", "feet"): "0.3048", ("length", "'"): "0.3048", ("length", "yd"): "0.9144", ("length", "mi"): "1609.344", ("length", "mile"): "1609.344", ("length", "miles"): "1609.344",
    ("mass", "t"): "1000000", ("mass", "tonne"): "1000000", ("mass", "tonnes"): "1000000", ("mass", "lb"): "453.59237", ("mass", "lbs"): "453.59237", ("mass", "oz"): "28.349523125",
    ("area", "ha"): "10000", ("area", "hectare"): "10000", ("area", "hectares"): "10000", ("area", "a"): "100", ("area", "are"): "100", ("area", "ares"): "100", ("area", "ar"): "100", ("area", "acre"): "4046.8564224", ("area", "acres"): "4046.8564224",
    ("volume", "l"): "0.001", ("volume", "litre"): "0.001", ("volume", "litres"): "0.001", ("volume", "liter"): "0.001", ("volume", "gal"): "0.003785411784", ("volume", "gallon"): "0.003785411784",
}
BASE_UNITS = {"time": "a", "length": "m", "mass": "g", "area": "m2", "volume": "m3"}
EXPONENTS = {"²": 2, "³": 3, "^2": 2, "^3": 3, "2": 2, "3": 3, "⁻¹": -1, "^-1": -1}
EPOCH_PHRASES = {
    BP: ("bp", "b.p.", "before present", "before the present", "before today", "ago", "vor heute", "avant le présent", "antes del presente", "prima del presente", "cal bp", "calbp", "14c yr bp", "14c bp"),
    B2K: ("b2k", "before 2000", "before ad 2000", "from ad 2000", "from the year 2000", "to the year 2000", "vor 2000", "avant 2000", "antes de 2000", "prima del 2000"),
    BCE: ("bc", "bce", "b.c.", "b.c.e.", "a.c.", "v. chr.", "v.chr.", "v. chr", "av. j.-c.", "av. j.-c", "avant j.-c.", "avant notre ère", "antes de cristo", "avanti cristo", "vor christus"),
    CE: ("ad", "ce", "a.d.", "c.e.", "d.c.", "n. chr.", "n.chr.", "ap. j.-c.", "ap. j.-c", "de notre ère", "después de cristo", "nach christus"),
    CALENDAR: ("calendar year", "calendar years", "calendar date", "calendar dates", "kalenderjahr", "kalenderjahre", "kalenderjahren", "année calendaire", "années calendaires", "año calendario", "años calendario", "anno di calendario"),
}
SIGNED = ("minus", "minus sign", "negative", "negativ", "négative", "négatives", "négatif", "negativo", "negativa", "negativos")
UNSIGNED = ("without a sign", "without sign", "ohne vorzeichen", "sans signe", "sin signo", "senza segno")
FIELD_WORDS = (
    "age ages date dates dating value values figure figures number numbers entry entries mindate field alter datierung datierungen wert werte edad edades fecha fechas valor valores âge âges valeur valeurs età data valore counted relative back gezählt gerechnet comptés comptées contados contate"
)
FILLERS = (
    "in of are is the a an as all listed given entered here not_ note earliest latest with and holds to at by en est la le les du de des d' plus ancienne früheste frühesten eingetragen saisie son las los el en il in di"
)
NEGATIONS = ("instead of", "not", "statt", "nicht", "au lieu de", "no", "en vez de", "invece di")
APPROX = ("ca.", "ca", "c.", "circa", "about", "approx.", "approximately", "around", "etwa", "um", "env.", "environ", "~", "≈")


def _lexicon() -> tuple[Trie, Trie, Trie, Trie]:
    words, prefixes, roots, exponents = Trie(), Trie(), Trie(), Trie()
    for sym, power in SYMBOL_PREFIXES.items():
        prefixes.add(sym, Entry("prefix", Decimal(10) ** power, 0.8 if power > 0 else -1.0))
    for power, names in SCALE_WORDS.items():
        for w in names.split():
            words.add(w, Entry("scale", Decimal(10) ** power, 2.0))
    for dim, names in ROOTS.items():
        for w in names:
            roots.add(w, Entry("root", dim, 1.0))
    for w, power in EXPONENTS.items():
        exponents.add(w, Entry("exponent", power, 0.5))
    for epoch, names in EPOCH_PHRASES.items():
        for w in names:
            words.add(w, Entry("epoch", epoch, 5.0 + 0.1 * len(w)))
    for kind, names, weight in (("signed", SIGNED, 2.0), ("unsigned", UNSIGNED, 3.0), ("field", FIELD_WORDS.split(), 1.5), ("filler", FILLERS.split(), 0.6), ("negation", NEGATIONS, 1.0), ("approx", APPROX, 1.5)):
        for w in names:
            words.add(w, Entry(kind, None, weight + 0.05 * len(w)))
    return words, prefixes, roots, exponents


WORDS, PREFIXES, ROOT_TRIE, EXPONENT_TRIE = _lexicon()
SEPARATORS = ".;,:()"
UNKNOWN = -2.0
#: log prior of a unit's dimension: beside a number of the field, and in running text, where bare one-letter units are rare
VALUE_PRIOR = {"time": 1.0, "length": -4.0, "mass": -4.0, "area": -4.0, "volume": -4.0}
TEXT_PRIOR = {"time": 0.3, "length": -0.6, "mass": -0.6, "area": -0.6, "volume": -0.6}


def segment(text: str, prior: dict[str, float]) -> list[tuple[str, object, int, int]]:
    """The best-scored cut of a text into (kind, value, start, end); ties go to the longer part that ends sooner.

    A root that stands for several dimensions with the same score, as no prior tells them apart, is of the dimension "open".
    """
    low = text.casefold() if len(text.casefold()) == len(text) else text.lower()
    n = len(text)
    best: list[list[tuple[float, tuple] | None]] = [[None, None] for _ in range(n + 1)]
    best[0][0] = (0.0, ())

    def put(j: int, state: int, score: float, path: tuple) -> None:
        old = best[j][state]
        if old is None or score > old[0] + 1e-12:
            best[j][state] = (score, path)

    def word_ends(j: int) -> bool:
        return j == n or not text[j].isalpha() or not text[j - 1].isalpha()

    for i in range(n):
        if here := best[i][0]:
            score, path = here
            ch = text[i]
            starts = i == 0 or not (text[i - 1].isalpha() and ch.isalpha())
            if ch in SEPARATORS:
                put(i + 1, 0, score, (path, ("sep", ch, i, i + 1)))
            elif not ch.isalnum():
                put(i + 1, 0, score, path)
            if ch.isdigit():
                j = i + 1
                while j < n and (text[j].isdigit() or text[j] in ".," and j + 1 < n and text[j + 1].isdigit()):
                    j += 1
                put(j, 0, score - 0.2, (path, ("number", text[i:j], i, j)))
            if starts:
                for j, e in WORDS.walk(low, i):
                    if word_ends(j):
                        put(j, 0, score + e.weight, (path, (e.kind, e.value, i, j)))
                for j, e in PREFIXES.walk(text, i):
                    put(j, 1, score + e.weight, (path, (e.kind, e.value, i, j)))
                for j, dimension, weight in roots_at(low, i, prior):
                    if word_ends(j):
                        put(j, 0, score + weight, (path, ("root", dimension, i, j)))
                if ch.isalpha():
                    j = i + 1
                    while j < n and text[j].isalpha():
                        j += 1
                    put(j, 0, score + UNKNOWN, (path, ("unknown", text[i:j], i, j)))
            if path and path[1][0] == "root" and path[1][3] == i:
                for j, e in EXPONENT_TRIE.walk(text, i):
                    put(j, 0, score + e.weight, (path, (e.kind, e.value, i, j)))
        if here := best[i][1]:
            score, path = here
            for j, dimension, weight in roots_at(low, i, prior):
                if word_ends(j):
                    put(j, 0, score + weight, (path, ("root", dimension, i, j)))
    parts, node = [], best[n][0][1] if best[n][0] else ()
    while node:
        node, part = node
        parts.append(part)
    return parts[::-1]


def roots_at(low: str, at: int, prior: dict[str, float]) -> Iterator[tuple[int, str, float]]:
    """(end, dimension, weight with prior) of the roots from a place on, of each end the likeliest dimension, "open" if two are as likely."""
    ends: dict[int, tuple[str, float]] = {}
    for j, e in ROOT_TRIE.walk(low, at):
        weight, old = e.weight + prior[e.value], ends.get(j)
        if old is None or weight > old[1] + 1e-12:
            ends[j] = (e.value, weight)
        elif abs(weight - old[1]) <= 1e-12 and e.value != old[0]:
            ends[j] = ("open", weight)
    return ((j, dimension, weight) for j, (dimension, weight) in ends.items())


def priors(dimension: str) -> dict[str, float]:
    """Log priors of a field of one dimension, as VALUE_PRIOR is that of years."""
    # a length may be raised to an area or a volume
    return {d: 1.0 if d == dimension else 0.0 if d == "length" and dimension in ("area", "volume") else -4.0 for d in ROOTS}


def measure(text: str, prior: dict[str, float]) -> tuple[Decimal, str] | None:
    """A quantity in base units and its dimension (see BASE_UNITS); None if the text does not state exactly one, or its dimension is open.

    The unit is one root with at most one prefix or scale word and one exponent; prefixes are raised with their root
    ("km²"), and lengths raised to the second or third power are areas and volumes.
    """
    m = _MEASURE.fullmatch(text.strip())
    if not m:
        return None
    parts = [p for p in segment(m["unit"].strip(), prior) if p[0] not in ("filler", "approx") and p[1] != "."]
    number = m["num"].replace("\u202f", "").replace("\u00a0", "").replace(" ", "").replace("'", "")
    value = Decimal(number.replace(",", ".") if re.fullmatch(r"[+-]?\d+,\d{1,2}", number) else number.replace(",", ""))
    scale, root, power = Decimal(1), None, 1
    for kind, what, start, end in parts:
        if kind in ("prefix", "scale") and root is None:
            scale *= what
        elif kind == "root" and root is None:
            root = (what, m["unit"].strip()[start:end].casefold())
        elif kind == "exponent" and root is not None and power == 1:
            power = what
        else:
            return None
    if root is None or root[0] == "open":
        return None
    dimension = root[0]
    if power != 1:
        dimension = {("length", 2): "area", ("length", 3): "volume"}.get((dimension, power))
        if dimension is None:
            return None
    return value * (scale * Decimal(SIZES.get(root, "1"))) ** power, dimension


def measures(df: DataFrame, key: str, value: str, dimension: str) -> DataFrame:
    """rec_key, quantity (double, in the base unit) and unit of each row whose value states one quantity of a dimension.

    Units that stand for several dimensions are read as the field's own. Null and blank values, limits, ranges, quantities
    of another dimension and unknown units give no row; repeated rows stay repeated; other columns are not read.
    """
    rows = df.where(F.coalesce(F.trim(value) != "", F.lit(False))).select(F.col(key).alias("rec_key"), F.col(value).alias("v"))
    kind, prior = df.schema[key].dataType.simpleString(), priors(dimension)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Cache(lambda v: measure(v, prior))
        for b in batches:
            out = [read[v] for v in b["v"]]
            keep = [x is not None and x[1] == dimension for x in out]
            yield pd.DataFrame({"rec_key": b["rec_key"][keep], "quantity": [float(x[0]) for x, k in zip(out, keep) if k], "unit": BASE_UNITS[dimension]})

    return rows.mapInPandas(run, f"rec_key {kind}, quantity double, unit string")


def _collect(parts: list[tuple]) -> Unit | None:
    """The unit that a run of parts states, if any."""
    scale, epoch = None, None
    for k, (kind, value, _, _) in enumerate(parts):
        if kind in ("prefix", "scale") and scale is None:
            scale = value
        elif kind == "epoch" and epoch is None:
            epoch = value
    if scale is None and epoch is None:
        return Unit(Decimal(1)) if any(p[0] == "root" and p[1] == "time" for p in parts) else None
    return Unit(scale, epoch)


def unit_in_text(text: str | None) -> Unit | None:
    """The unit of a field of years that a note, description or remark states; None if it states none.

    A unit right behind a number measures something else, one behind "not" or "instead of" is denied, and a clause in
    which a unit stands among words that are about neither ages nor units (a sector BC, a BP stone) says nothing.
    """
    if not text:
        return None
    clauses: list[list[tuple]] = [[]]
    for part in segment(text, TEXT_PRIOR):
        if part[0] == "sep":
            clauses.append([])
        else:
            clauses[-1].append(part)
    scale = epoch = None
    signed = unsigned = stated = False
    for clause in clauses:
        kinds = [p[0] for p in clause]
        if "negation" in kinds:
            clause = clause[: kinds.index("negation")]
        units, measured = [], False
        for k, part in enumerate(clause):
            if part[0] == "number":
                measured = True
                continue
            if part[0] in ("prefix", "scale", "root", "epoch", "exponent"):
                if not measured:
                    units.append(part)
                continue
            measured = False
        kinds = [p[0] for p in clause]
        about = "field" in kinds or "signed" in kinds or any(p[0] == "root" and p[1] == "time" and p[3] - p[2] > 2 for p in units)
        signed |= "signed" in kinds
        unsigned |= "unsigned" in kinds
        unit = _collect([p for p in units if not (p[0] == "root" and p[1] != "time")])
        bare_time = any(p[0] == "root" and p[1] == "time" for p in units)
        other_dimension = any(p[0] == "root" and p[1] != "time" for p in units)
        if unit is None or other_dimension and not bare_time and unit.epoch is None:
            continue
        if about or "unknown" not in kinds and "number" not in kinds:
            stated |= unit.epoch is not None or unit.scale != 1
            scale = unit.scale if scale is None and unit.scale not in (None, Decimal(1)) else scale
            epoch = unit.epoch if epoch is None else CALENDAR if CALENDAR in (epoch, unit.epoch) else epoch
    if not stated:
        return None
    if epoch == BCE and signed and not unsigned:
        epoch = CALENDAR
    return Unit(scale, epoch)


_MEASURE = re.compile(r"(?:ca?\.? |about |~ ?)?(?P<num>[+-]?\d{1,3}(?:[ '\u00a0\u202f]\d{3})+(?:\.\d+)?|[+-]?\d+(?:[.,]\d+)*)\s*(?P<unit>[^\d<>±].{0,60})", re.S)
_PLAIN = re.compile(r"\s*[+-]?\d+(\.\d+)?\s*")
_VALUE = re.compile(
    r"(?P<pre>[^\d+\-−–]*?)\s*(?P<sign>[+\-−–]?)(?P<num>\d{1,3}(?:[ ,'’]\d{3})+(?![\d])(?:\.\d+)?|\d+(?:[.,]\d+)?)(?P<err>\s*(?:±|\+/-|\+-|\+/−)\s*\d+(?:[.,]\d+)?)?(?P<post>.*)",
    re.S,
)


def parse_value(text: str) -> tuple[Decimal, Unit | None] | None:
    """The signed number and the unit written with it; None for limits, ranges, words and what is not understood."""
    t = re.sub(r"[   ]", " ", text).strip()
    m = _VALUE.fullmatch(t)
    if not m:
        return None
    before, after = segment(m["pre"], VALUE_PRIOR), segment(m["post"], VALUE_PRIOR)
    known = {"epoch", "sep", "filler"}
    if any(p[0] not in known | {"approx"} for p in before) or any(p[0] not in known | {"prefix", "scale", "root", "exponent"} for p in after):
        return None
    if any(ch in m["pre"] + m["post"] for ch in "<>≤≥?/–−+-=") and not re.fullmatch(r"[^<>≤≥?/–−+=]*", m["pre"] + re.sub(r"(?i)j\.-c\.?", "", m["post"])):
        return None
    if re.search(r"-\s*\d", m["post"]):
        return None
    unit = _collect(before + after)
    if unit is None and (m["pre"].strip(" .~≈") or m["post"].strip()) and not any(p[0] == "approx" for p in before):
        return None
    if any(p[0] == "root" and p[1] != "time" for p in after):
        return None
    num = m["num"]
    if re.search(r"[ ,'’]\d{3}", num) and not ("," in num and unit and unit.scale not in (None, Decimal(1))):
        num = re.sub(r"[ ,'’]", "", num)
    value = Decimal(num.replace(",", "."))
    if m["sign"] in ("-", "−", "–") and m["sign"]:
        value = -value
    return value, unit


def to_year(value: Decimal, unit: Unit) -> Decimal:
    """Signed calendar year."""
    v = value * (unit.scale or 1)
    return {BP: 1950 - v, B2K: 2000 - v, BCE: -abs(v), CE: v, CALENDAR: v}[unit.epoch]


def reading(text: str, stated: tuple[Unit | None, ...], common: str) -> tuple[Decimal, Unit] | None:
    """The signed calendar year that a value means and the unit it was read in; None if it is not one quantity.

    The unit written with the value goes before the stated ones, in order. A scale without an epoch counts back from the
    present; a minus sign without one marks a calendar year, as an age is never negative.
    """
    parsed = parse_value(text)
    if parsed is None:
        return None
    value, written = parsed
    unit = written if written and (written.epoch or written.scale not in (None, Decimal(1))) else None
    if unit is None and value < 0 and ("−" in text or "–" in text):
        unit = Unit(None, CALENDAR)
    if unit is None:
        unit = next((u for u in stated if u), None)
    if unit is None or value < 0 and unit.epoch != CALENDAR:
        unit = Unit(None, CALENDAR if value < 0 else common)
    if unit.epoch is None:
        unit = Unit(unit.scale, BP)
    year = to_year(value, unit)
    return (year, unit) if abs(year) <= MOST_YEARS else None


def standard(text: str, stated: tuple[Unit | None, ...], common: str) -> int | None:
    """The value in the common unit (BP or CALENDAR), or None if it is no case: not one quantity, or plainly in that unit already."""
    found = reading(text, stated, common)
    if found is None:
        return None
    year, unit = found
    if unit.epoch == common and unit.scale in (None, Decimal(1)) and _PLAIN.fullmatch(text):
        return None
    return int((1950 - year if common == BP else year).quantize(Decimal(1), ROUND_HALF_UP))


class Cache(dict):
    """A memo of bounded size: emptied when it is full."""

    def __init__(self, make, most: int = 50_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out


def stated_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and unit (a code, null if none is stated) for each row of a list of sources with remarks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"unit_key": b["k"], "unit": [u.code() if (u := unit_in_text(t)) else None for t in b["t"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"unit_key {kind}, unit string")


def _rows(df: DataFrame, key: str, value: str, note: str | None, source: str | None, common: str, sources: DataFrame | None) -> tuple[DataFrame, Column]:
    """rec_key, v, n and unit of the rows with a value, and whether a row is a plain number in the common unit about which no note says anything."""
    rows = df.where(F.coalesce(F.trim(value) != "", F.lit(False))).select(F.col(key).alias("rec_key"), F.col(value).alias("v"), (F.col(note) if note else F.lit(None).cast("string")).alias("n"), (F.col(source) if source else F.lit(None).cast("string")).alias("unit_key"))
    if sources is not None:
        rows = rows.join(sources.where(F.col("unit").isNotNull()), "unit_key", "left")
    else:
        rows = rows.withColumn("unit", F.lit(None).cast("string"))
    number = r"^\s*\+?\d{1,9}(\.\d{1,9})?\s*$" if common == BP else r"^\s*[+-]?\d{1,9}(\.\d{1,9})?\s*$"
    plain = F.col("n").isNull() & (F.col("unit").isNull() | (F.col("unit") == Unit(None, common).code())) & F.col("v").rlike(number)
    return rows.select("rec_key", "v", "n", "unit"), plain


def standard_values(df: DataFrame, key: str, value: str, note: str | None, source: str | None, common: str, sources: DataFrame | None = None) -> DataFrame:
    """rec_key and std_value (bigint) for each row whose value states one quantity and is not plainly in the common unit.

    sources: unit_key and unit, as stated_units gives them, joined on the source column; Spark broadcasts them where their
    size is under its threshold. Null and blank values, limits, ranges and words give no row; null notes and sources
    state nothing; repeated rows stay repeated; an empty table gives no rows; other columns are not read.
    """
    rows, plain = _rows(df, key, value, note, source, common, sources)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notes, units = Cache(unit_in_text), Cache(Unit.of)
        for b in batches:
            out = [standard(v, (notes[n] if n else None, units[u]), common) for v, n, u in zip(b["v"], b["n"], b["unit"])]
            keep = [x is not None for x in out]
            yield pd.DataFrame({"rec_key": b["rec_key"][keep], "std_value": pd.array([x for x in out if x is not None], dtype="int64")})

    return rows.where(~plain).mapInPandas(run, f"rec_key {kind}, std_value bigint")


def calendar_years(df: DataFrame, key: str, value: str, note: str | None, source: str | None, common: str, sources: DataFrame | None = None) -> DataFrame:
    """rec_key and year (double, BCE negative) for each row whose value states one quantity, in whatever unit; else as standard_values."""
    rows, plain = _rows(df, key, value, note, source, common, sources)
    kind = df.schema[key].dataType.simpleString()
    number = F.trim("v").try_cast("double")
    easy = rows.where(plain).select("rec_key", (1950.0 - number if common == BP else number).alias("year"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notes, units = Cache(unit_in_text), Cache(Unit.of)
        for b in batches:
            out = [reading(v, (notes[n] if n else None, units[u]), common) for v, n, u in zip(b["v"], b["n"], b["unit"])]
            keep = [x is not None for x in out]
            yield pd.DataFrame({"rec_key": b["rec_key"][keep], "year": pd.array([float(x[0]) for x in out if x is not None], dtype="float64")})

    return easy.unionByName(rows.where(~plain).mapInPandas(run, f"rec_key {kind}, year double"))
