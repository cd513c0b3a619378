import pytest

from arcspan.operators.units import BP, CALENDAR, Unit, measure, measures, priors, standard, standard_values, stated_units, unit_in_text


@pytest.mark.parametrize(
    "text, want",
    [
        ("3100", None), (" 3100", None), ("3100.0", None), ("3100 BP", 3100), ("3100BP", 3100), ("3 100 BP", 3100), ("3,100 BP", 3100), ("3,71 ka BP", 3710), ("2.565 ka", 2565), ("3.26 kya", 3260), ("0.0034 Ma", 3400), ("4000 b2k", 3950),
        ("3100±50", 3100), ("3100 +/- 50 BP", 3100), ("ca. 1700 BP", 1700), ("2550 14C yr BP", 2550), ("2880 cal BP", 2880), ("560 BC", 2510), ("BC 560", 2510), ("c. 900 B.C.", 2850), ("560 a.C.", 2510), ("560 v. Chr.", 2510), ("560 av. J.-C.", 2510), ("AD 329", 1621), ("400 CE", 1550), ("10 n. Chr.", 1940), ("−560", 2510), ("-560", 2510),
        (">43000", None), ("> 38,500 BP", None), ("<200", None), ("greater than 45 ka", None), ("4100-4500", None), ("3.1-3.4 ka", None), ("modern", None), ("?", None), ("-", None), ("5 m", None), ("12 ha", None),
    ],
)
def test_ages(text, want):
    assert standard(text, (), BP) == want


def test_calendar_years():
    assert standard("2.58 ka", (), CALENDAR) == -630
    assert standard("760.0", (), CALENDAR) is None
    assert standard("4720", (Unit(None, "bce"),), CALENDAR) == -4720
    assert standard("2000", (unit_in_text("Earliest date in thousands of years before present."),), CALENDAR) == 1950 - 2_000_000
    assert standard("before 500 BC", (), CALENDAR) is None
    assert standard("-200/-100", (), CALENDAR) is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("age entered in ka", "1000|"), ("value given in kyr, not years", "1000|"), ("b2k", "|b2k"), ("relative to the year 2000, not 1950", "|b2k"), ("Kalenderjahr, v. Chr. negativ", "|cal"), ("calendar date entered instead of BP, BCE negative", "|cal"),
        ("sector BC, square 12", None), ("AD-trench, north face", None), ("sample 3 ka-7, small", None), ("weight 1.2 g", None), ("2 m below surface", None), ("Walls visible; 2 ka of ploughing above them.", None), ("A list; BP marker stone nearby.", None),
        ("Copied from cards; the ka column of the cards was left out, ages are in years BP.", "|bp"), ("Earliest date is BCE, entered without a sign.", "|bce"), ("", None), (None, None),
    ],
)
def test_statements(text, want):
    unit = unit_in_text(text)
    assert (unit.code() if unit else None) == want


def test_order_of_sources_and_edges(spark):
    sources = spark.createDataFrame([("K", "All ages are listed in thousands of years before present."), ("N", None), (None, "Ages b2k")], "code string, remark string")
    rows = spark.createDataFrame(
        [(1, "3.5", None, "K", 9), (2, "3", "b2k", "K", 9), (3, "3500 BP", "age entered in ka", "K", 9), (4, "3500", None, "N", 9), (5, None, None, "K", 9), (6, "  ", None, "K", 9), (None, "1 ka", None, None, 9), (7, "1 ka", None, "unknown", 9), (7, "1 ka", None, "unknown", 9), (8, "9" * 3000, None, None, 9), (9, "9" * 3000 + " BP", None, None, 9), (10, "9" * 40 + " ka", None, None, 9), (11, "x" * 100000, "y" * 100000, None, 9)],
        "id long, v string, note string, src string, unit int",
    )
    got = sorted(map(tuple, standard_values(rows, "id", "v", "note", "src", BP, stated_units(sources, "code", "remark")).collect()), key=str)
    # a note goes before a remark as a whole: b2k counts the figure in years
    assert got == sorted([(1, 3500), (2, -47), (3, 3500), (None, 1000), (7, 1000), (7, 1000)], key=str)
    assert standard_values(rows.limit(0), "id", "v", "note", "src", BP).count() == 0


@pytest.mark.parametrize(
    "text, dimension, want",
    [
        ("25 a", "time", 25), ("25 a", "area", 2500), ("3 ka", "time", 3000), ("3 ka", "area", 300000), ("1.5 km²", "area", 1_500_000), ("12 cm", "length", 0.12), ("2 thousand ha", "area", 20_000_000), ("5 ft", "length", 1.524), ("4 l", "volume", 0.004), ("2 m^3", "volume", 2),
        ("1 200 kg", "mass", 1_200_000), ("7 t", "mass", 7_000_000), ("2 m", "time", None), ("5", "length", None), ("<5 m", "length", None), ("3-4 m", "length", None), ("5 wug", "mass", None), ("5 m m", "length", None), ("3 acres", "area", 12140.5692672),
    ],
)
def test_measure(text, dimension, want):
    found = measure(text, priors(dimension))
    if want is None:
        assert found is None or found[1] != dimension
    else:
        assert found[1] == dimension and float(found[0]) == pytest.approx(want)


def test_priors_decide():
    """Without priors "a" and "ka" may be years or ares: no unit, so that no value with them is brought to years."""
    from arcspan.operators import units

    none = dict.fromkeys(units.ROOTS, 0.0)
    assert measure("25 a", none) is None and measure("3 ka", none) is None and measure("12 cm", none) is not None
    assert units.standard("12.5 ka", (None, None), units.BP) == 12500
    old, units.VALUE_PRIOR = units.VALUE_PRIOR, none
    try:
        assert units.standard("12.5 ka", (None, None), units.BP) is None
    finally:
        units.VALUE_PRIOR = old


def test_measures(spark):
    df = spark.createDataFrame([(1, "25 a", 0), (2, None, 0), (None, "1 km2", 0), (1, "25 a", 0), (3, "5 m", 0), (4, " ", 0), (5, "x" * 5000, 0)], "id long, v string, unit int")
    got = sorted([tuple(r) for r in measures(df, "id", "v", "area").collect()], key=str)
    assert got == sorted([(1, 2500.0, "m2"), (1, 2500.0, "m2"), (None, 1e6, "m2")], key=str)
    assert measures(df.limit(0), "id", "v", "area").count() == 0
