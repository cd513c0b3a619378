import json
import zipfile

import numpy as np
from arcspan.sources import points as src

KML = '<?xml version="1.0"?><kml><Document><Placemark><name>A</name><Point><coordinates>10.5,20.5,3</coordinates></Point></Placemark><Placemark><name>B</name><styleUrl>#late</styleUrl><Point><coordinates>bad</coordinates></Point></Placemark></Document></kml>'


def test_csv_and_wide(spark, tmp_path):
    (tmp_path / "s.csv").write_text('name,lat,lon\n"A, b",10,20\nB,N/A,20\nC,91,1\nD,0,0\n,1,1\n')
    rows = src.read_csv(spark, str(tmp_path / "s.csv"), ["name", "lat", "lon"]).collect()
    assert [(r["name"], r["lat"]) for r in rows] == [("A, b", 10.0), (None, 1.0)]
    assert src.read_csv(spark, str(tmp_path / "s.csv"), ["name", "lat", "lon"], keep_bad=True).count() == 5
    (tmp_path / "w.tsv").write_text("id\ta\tb\nx\t1\tz\n")
    assert {(r["flag"], r["value"]) for r in src.read_wide_flags(spark, str(tmp_path / "w.tsv"), ["id"], ["a", "b"]).collect()} == {("a", 1), ("b", 0)}
    (tmp_path / "p.txt").write_text("# note\nage\tv\n1\tx\n2.5\t7\n")
    assert [tuple(r) for r in src.read_proxy(spark, str(tmp_path / "p.txt"), ["age", "v"]).collect()] == [("1.0", "x"), ("2.5", "7.0")]


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "stone_circle (2).kml").write_text(KML)
    rows = src.read_kml(spark, str(tmp_path / "*.kml")).collect()
    assert [tuple(r) for r in rows] == [("A", 20.5, 10.5, "stone circle")]
    with zipfile.ZipFile(tmp_path / "z.kmz", "w") as z:
        z.writestr("doc.kml", KML)
    assert [(r["name"], r["lat"]) for r in src.read_kmz(spark, str(tmp_path / "z.kmz")).collect()] == [("A", 20.5)]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sites": [{"name": "x", "lat": 1, "lng": 2}, {"name": "y", "lat": 1, "lon": 3, "lng": 9}, {"name": "z"}]}))
    assert [(r["name"], r["lon"]) for r in src.read_sites_json(spark, str(tmp_path / "a.json")).collect()] == [("x", 2.0), ("y", 3.0)]
    (tmp_path / "m.json").write_text(json.dumps([{"measurement": {"bp": 100, "lat": 1, "lng": 2, "site": "s"}}, {"measurement": {"bp": -5, "lat": 1, "lng": 2}}, {}]))
    assert [(r["site"], r["bp"]) for r in src.read_measurements_json(spark, str(tmp_path / "m.json")).collect()] == [("s", 100.0)]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": {"t": "q"}}, {"geometry": {"type": "Polygon", "coordinates": []}, "properties": {}}]}))
    assert [tuple(r) for r in src.read_geojson(spark, str(tmp_path / "g.json"), ["t"]).collect()] == [(6.0, 5.0, "q")]


def test_raster_and_sinks(spark, tmp_path):
    (tmp_path / "g.bin").write_bytes(b"hd" + np.arange(6, dtype=">u2").tobytes())
    got = src.read_raster(spark, str(tmp_path / "g.bin"), 2, 3, skip=2, scale=2.0, offset=1.0).orderBy("row", "col").collect()
    assert [r["value"] for r in got] == [1.0, 3.0, 5.0, 7.0, 9.0, 11.0]
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, v double")
    src.write_json(df, str(tmp_path / "out.json"))
    assert sorted(json.loads(line)["v"] or 0 for f in (tmp_path / "out.json").glob("part*") for line in f.read_text().splitlines()) == [0, 3.0]
    src.write_csv(df, str(tmp_path / "out.csv"))
    assert spark.read.csv(str(tmp_path / "out.csv"), header=True).count() == 2
