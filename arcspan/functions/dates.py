"""Radiocarbon calibration by pieces, and dates told in words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: breakpoints in BP, factor and constant of each piece
CALIBRATION_1 = ((2500, 1.0, 0.0), (5000, 1.05, 50.0), (8000, 1.08, 100.0), (12000, 1.12, 200.0), (None, 1.15, 300.0))
CALIBRATION_2 = ((2000, 1.0, 0.0), (5000, 1.05, -100.0), (10000, 1.08, -250.0), (None, 1.10, -450.0))

# fixed values: period words and the age in BP each stands for, the first that occurs counts
PERIODS = (
    ("paleolithic", 40000), ("palaeolithic", 40000), ("mesolithic", 12000), ("epipaleolithic", 12000), ("neolithic", 7000), ("bronze age", 4000), ("iron age", 2800), ("roman", 2200), ("hellenistic", 2200), ("medieval", 1000), ("mediaeval", 1000), ("byzantine", 1000),
)


def _pieces(bp: Column, table, closed: bool) -> Column:
    out = None
    for limit, factor, add in table:
        value = bp * factor + add
        hit = None if limit is None else bp <= limit if closed else bp < limit
        if out is None:
            out = F.when(hit, value)
        elif limit is None:
            out = out.otherwise(value)
        else:
            out = out.when(hit, value)
    return out


def calibrated_year(bp, version: int = 1) -> Column:
    """Calendar year (BCE negative) of a radiocarbon age.

    Version 1: ages of at most 0 are 1950, a piece ends before its limit; version 2: no such rule, a piece holds its limit.
    """
    c = F.col(bp) if isinstance(bp, str) else bp
    if version == 1:
        return F.when(c <= 0, F.lit(1950.0)).otherwise(1950.0 - _pieces(c, CALIBRATION_1, False))
    return 1950.0 - _pieces(c, CALIBRATION_2, True)


def year_label(year) -> Column:
    c = F.col(year) if isinstance(year, str) else year
    return F.concat(F.abs(c).cast("string"), F.when(c < 0, F.lit(" BCE")).otherwise(F.lit(" CE")))


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("long")


def parse_date(text) -> Column:
    """Signed year that a date begins with: "13th c CE" (the middle of the century), "2500 BCE", "300-100 BCE" (the middle, rounded down).

    A range whose first year has no era is BCE if the second has one; "500 BCE-500 CE" is read as its first year. Null else.
    """
    t = F.col(text) if isinstance(text, str) else text
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    signed = lambda n, era: F.when(era == "BCE", -n).otherwise(n)
    century, single, spread = r"^(\d{1,9})(?:st|nd|rd|th)\s+c\s+(BCE|CE)", r"^(\d{1,9})\s*(BCE|CE)", r"^(\d{1,9})\s*(BCE|CE)?[-–](\d{1,9})\s*(BCE|CE)?"
    c, n = _found(part(century, 1)), _found(part(single, 1))
    y1, e1, y2, e2 = _found(part(spread, 1)), part(spread, 2), _found(part(spread, 3)), part(spread, 4)
    first = F.when((e1 == "BCE") | (e1 == "") & (e2 != ""), -y1).otherwise(y1)
    return F.when(c.isNotNull(), signed((c - 1) * 100 + 50, part(century, 2))).when(n.isNotNull(), signed(n, part(single, 2))).when(y2.isNotNull(), F.floor((first + signed(y2, e2)) / 2))


def years_bce(text) -> Column:
    """Years BCE, CE negative: of a signed year, "3000 BC", "500 AD", "3rd millennium BCE" and "13th c CE" (counted from its end)."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    plain = t.try_cast("double")
    part = lambda pattern: _found(F.regexp_extract(t, "(?i)^" + pattern, 1))
    bce, ce, thousand, century, century_bce = part(r"(\d{1,9})\s*BCE?"), part(r"(\d{1,9})\s*(?:CE|AD)"), part(r"(\d{1,9})\w*\s*millennium\s*BCE?"), part(r"(\d{1,9})\w*\s*c(?:entury)?\s*(?:CE|AD)"), part(r"(\d{1,9})\w*\s*c(?:entury)?\s*BCE?")
    return F.when(plain.isNotNull(), -plain).when(bce.isNotNull(), bce).when(ce.isNotNull(), -ce).when(thousand.isNotNull(), thousand * 1000).when(century.isNotNull(), -century * 100).when(century_bce.isNotNull(), century_bce * 100).cast("double")


def period_age(text) -> Column:
    """Age in BP of the first period word of the list that occurs; a word that holds another is never reached behind it."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    out = None
    for word, age in PERIODS:
        hit = F.contains(t, F.lit(word))
        out = F.when(hit, F.lit(age)) if out is None else out.when(hit, F.lit(age))
    return out


def publication_year(text, source=None) -> Column:
    """The last four figures in brackets, else the first that stand between signs or spaces, else the last in the source's name, else null."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    bracketed = F.regexp_extract_all(t, F.lit(r"\((\d{4})\)"), F.lit(1))
    free = F.regexp_extract(t, r"(?:^|[.\s:])(\d{4})(?:[.\s,;:\-]|$)", 1)
    years = [F.try_element_at(bracketed, F.lit(-1)), F.nullif(free, F.lit(""))]
    if source is not None:
        named = F.regexp_extract_all(F.col(source) if isinstance(source, str) else source, F.lit(r"(\d{4})"), F.lit(1))
        years.append(F.try_element_at(named, F.lit(-1)))
    return F.coalesce(*years).cast("int")
