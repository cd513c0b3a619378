import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcspan.functions import classify, dates, geo
from arcspan.operators import joins, learning, lines, poles, raster, stats, windows
from arcspan.sources import points as src


def test_best_pole_is_found_by_scans(spark):
    trace = spark.range(0, 360, 9).select(geo.point_lat(F.col("id")).alias("lat"), geo.point_lon(F.col("id")).alias("lon"))
    for by in ("rms_km", "max_km"):
        lat, lon, error = poles.best_pole(trace, by, levels=6)
        assert error < 40 and abs(lat - geo.DEFAULT_POLE[0]) < 0.5 and abs(lon - geo.DEFAULT_POLE[1]) < 1.0
    assert poles.best_pole(trace.limit(0)) is None


def test_nearest_with_hot_leaf_ties_and_bad_rows(spark):
    left = spark.createDataFrame([(1, 10.0, 10.0), (2, -80.0, 179.9), (3, None, 1.0), (4, 95.0, 1.0), (1, 10.0, 10.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(i, 10.0, 10.5) for i in range(40)] + [(99, -80.0, -179.9), (None, 10.0, 10.0), (50, float("nan"), 10.0)], "id long, lat double, lon double")
    got = {r["id"]: (r["nearest"], round(r["km"], 3)) for r in joins.nearest(left, right, "id", "id", leaf_rows=4, group_rows=8).collect()}
    assert got[1][0] == 0 and got[2][0] == 99 and set(got) == {1, 2}


def test_ring_counts(spark):
    s = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 108.0), (2, 0.0, -108.2), (3, 0.0, 90.0), (4, None, 1.0)], "id long, lat double, lon double")
    got = {r["centre_id"]: r["n"] for r in poles.ring_counts(s, [(0, 0.0, 0.0), (3, 0.0, 90.0)], 107.5, 108.5).collect()}
    assert got == {0: 2, 3: 0}


def test_lines(spark):
    v = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 0.0, 10.0), ("a", 2, 0.0, 20.0), ("b", 0, 0.0, 179.0), ("b", 1, 0.0, -179.0), ("c", 0, 1.0, 1.0)], "line string, k int, lat double, lon double")
    assert {(r["line"], r["k"]) for r in lines.segments(v, "line", "k").collect()} == {("a", 0), ("a", 1)}
    got = {r["line"]: r["rms_km"] for r in lines.straight_deviation(v, "line", "k").collect()}
    assert got["a"] == pytest.approx(0, abs=1e-6) and got["c"] == 0
    assert {r["line"]: r["km"] for r in lines.lengths(v, "line", "k").collect()}["a"] == pytest.approx(2 * 1111.95, abs=0.1)


def test_focal_and_suitability(spark):
    grid = spark.range(25).select((F.col("id") / 5).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    got = {(r["row"], r["col"]): r for r in raster.focal(grid, 1).collect()}
    assert got[(2, 2)]["mean"] == 12.0 and got[(0, 0)]["mean"] == pytest.approx(3.0) and got[(2, 2)]["highest"] == 18.0 and got[(4, 4)]["lowest"] == 18.0
    both = raster.suitability([(grid, 0.5), (grid.where("row < 2"), 1.0)])
    assert both.count() == 10 and both.where("row = 1 and col = 1").first()["value"] == 9.0


def test_folds_and_auc(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(i % 2), float(i % 2 + rng.normal(0, 0.3)), None if i % 9 == 0 else float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label double, good double, noise double")
    counts = learning.folded(df, "label", "id", 5).groupBy("fold", "label").count().toPandas()
    assert counts["count"].max() - counts["count"].min() <= 1 and len(counts) == 10
    assert min(learning.auc_by_fold(df, ["good", "noise"], "label", "id", 2)) > 0.95
    assert {r["feature"]: r["importance"] for r in learning.importances(df, ["good", "noise"], "label", 10, 4).collect()}["good"] > 0.7


def test_dates_and_classes(spark):
    texts = ["13th c CE", "2nd c BCE", "2500 BCE", "300-100 BCE", "1200 CE", "500 BCE-500 CE", "300-101 BCE", "debated", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(dates.parse_date("t")).collect()]
    assert got == [1250, -150, -2500, -200, 1200, -500, -201, None, None]
    texts = ["-2000", "500", "3000 BC", "500 AD", "3rd millennium BCE", "13th c CE", "13th century BC", "x", " "]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(dates.years_bce("t")).collect()]
    assert got == [2000, -500, 3000, -500, 3000, -1300, 1300, None, None]
    kinds = [("pyramid", None), ("tomb", -3000), ("citadel", 600), ("citadel", None), ("city", -600), ("city", 10), ("city", None), ("odd", 5)]
    got = [r[0] for r in spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(kinds)], "k int, t string, y int").orderBy("k").select(classify.era_class("t", "y")).collect()]
    assert got == ["prehistoric", "later", "later", "prehistoric", "prehistoric", "later", "prehistoric", "prehistoric"]
    assert spark.range(1).select(classify.member_class(F.lit("fort"))).first()[0] == "military"
    r = spark.range(1).select(dates.period_age(F.lit("Epipaleolithic layer")).alias("a"), dates.year_label(F.lit(-5)).alias("b"), dates.publication_year(F.lit("x (1999) and (2005) 1980")).alias("c"), dates.publication_year(F.lit("none")).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (40000, "5 BCE", 2005, None)
    r = spark.range(1).select(classify.set_class(F.array(F.lit("temple"), F.lit("villa"))).alias("a"), classify.set_class(F.array(F.lit("temple"), F.lit("villa")), both=True).alias("b"), classify.set_class(F.lit(None).cast("array<string>")).alias("c"), classify.keyword_class(F.lit("Old TEMPLE (x)"), [("t", ["temple (x)"]), ("u", ["old"])]).alias("d")).first()
    assert tuple(r) == ("monument", "both", "other", "t")


def test_interpolated_and_curve(spark):
    df = spark.createDataFrame([(0.5, 2.0), (3.5, 8.0), (None, 1.0), (9.0, 7.0)], "t double, v double")
    got = [r["value"] for r in windows.interpolated_bins(df, "t", "v", -1.0, 5.0, 1.0).orderBy("bin").collect()]
    assert got == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    c = windows.on_curve(df, "t", [(0.0, 0.0), (1.0, 10.0)], "y").orderBy("t").collect()
    assert [r["y"] for r in c] == [None, 5.0, 10.0, 10.0]


def test_fisher_and_ks(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, True)] + [(False, False)] * 3 + [(None, True)], "r boolean, c boolean")
    assert stats.two_by_two(df, F.col("r"), F.col("c")).first()["p"] == pytest.approx(17 / 70)
    x = spark.createDataFrame([("a", float(v)) for v in range(50)] + [("b", float(v) + 20) for v in range(50)], "g string, v double")
    assert stats.kolmogorov_smirnov(x, "v", "g", "a").first()["d"] == pytest.approx(0.4)


def test_spreadsheet_and_shapes(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Other"/><sheet name="All"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>site</t></si><si><t>Foo</t></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>4.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(buf.getvalue())
    assert [tuple(r) for r in src.read_xlsx(spark, str(tmp_path / "a.xlsx"), "All", {"name": 0, "age": 2, "none": 7}).collect()] == [("Foo", "4.5", None)]
    assert src.read_xlsx(spark, str(tmp_path / "a.xlsx"), "Missing", {"name": 0}).count() == 0
    line = struct.pack("<i4d2i", 3, 0, 0, 2, 2, 1, 3) + struct.pack("<i", 0) + struct.pack("<6d", 0, 1, 1, 2, 2, 3)
    point = struct.pack("<i2d", 1, 7, 8)
    body = b"".join(struct.pack(">2i", k + 1, len(r) // 2) + r for k, r in enumerate((line, point)))
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + body)
    got = [tuple(r) for r in src.read_shapefile(spark, str(tmp_path / "a.shp")).orderBy("shape", "vertex").collect()]
    assert got == [(0, 0, 0, 1.0, 0.0), (0, 0, 1, 2.0, 1.0), (0, 0, 2, 3.0, 2.0), (1, 0, 0, 8.0, 7.0)]


def test_fitted_to_draws(spark):
    from arcspan.operators.fit import fitted_to_draws

    trace = spark.range(0, 360, 3).select((F.col("id") / 3).cast("long").alias("row"), geo.point_lat(F.col("id")).alias("lat"), geo.point_lon(F.col("id")).alias("lon"))
    rows = fitted_to_draws(trace, 120, 6, 8, 10.0).collect()
    assert len(rows) == 6 and all(r["n"] == 120 and abs(r["pole_lat"] - geo.DEFAULT_POLE[0]) < 1e-4 for r in rows)
