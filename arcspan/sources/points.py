"""Point tables from delimited text, XML, JSON and binary rasters, read with explicit schemas; rows that do not cast are dropped or kept as asked."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITES = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "lat", "lon", "type", "source")])


def _double(c: Column) -> Column:
    """A number, or null for blanks, sentinels such as N/A and NaN."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def valid(lat: Column, lon: Column, origin: bool = False) -> Column:
    """In range; without origin, (0, 0) is not a position."""
    good = lat.between(-90, 90) & lon.between(-180, 180)
    return good if origin else good & ~((lat == 0) & (lon == 0))


def read_csv(spark: SparkSession, path: str, columns: list[str], lat: str = "lat", lon: str = "lon", keep_bad: bool = False, sep: str = ",", origin: bool = False) -> DataFrame:
    """All columns as strings but lat and lon, which are numbers; rows without a valid position are dropped unless keep_bad.

    columns: the file's columns in order. Nothing is inferred, so that a scan reads the file once.
    """
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=False)
    out = raw.withColumns({lat: _double(F.col(lat)), lon: _double(F.col(lon))})
    return out if keep_bad else out.where(F.coalesce(valid(F.col(lat), F.col(lon), origin), F.lit(False)))


def read_wide_flags(spark: SparkSession, path: str, keys: list[str], flags: list[str], sep: str = "\t") -> DataFrame:
    """A wide table of 0/1 columns as rows (keys, flag, value); what is no whole number counts as 0."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*keys, *flags]])
    wide = spark.read.schema(schema).csv(path, header=True, sep=sep)
    return wide.unpivot(keys, flags, "flag", "value").withColumn("value", F.coalesce(F.col("value").try_cast("int"), F.lit(0)))


def read_proxy(spark: SparkSession, path: str, columns: list[str], comment: str = "#", sep: str = "\t") -> DataFrame:
    """A commented table of measurements: lines that start with the sign are skipped, the first other line names the columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, sep=sep, comment=comment).select(*[F.coalesce(_double(F.col(c)).cast("string"), F.col(c)).alias(c) for c in columns])


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lon and type of each Placemark with a point; coordinates are "lon,lat[,alt]", type comes from the file name."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("Point", T.StructType([T.StructField("coordinates", T.StringType())]))])
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path).withColumn("file", F.input_file_name())
    at = F.split(F.trim(F.col("Point.coordinates")), ",")
    rows = marks.select("name", _double(F.try_element_at(at, F.lit(2))).alias("lat"), _double(F.try_element_at(at, F.lit(1))).alias("lon"), file_type(F.col("file")).alias("type"))
    return rows.where(F.coalesce(valid(F.col("lat"), F.col("lon")), F.lit(False)))


def file_type(path: Column) -> Column:
    """The file's name without folder, ending and trailing "(2)", underscores as spaces."""
    name = F.regexp_replace(F.url_decode(F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)), "_", " ")
    return F.trim(F.regexp_replace(name, r"\s*\(\d+\)$", ""))


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """name, style, lat and lon of the Placemarks in zipped KML files; a file is one task, as it cannot be cut."""
    import xml.etree.ElementTree as ET

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.endswith(".kml"):
                            for mark in ET.fromstring(z.read(member)).iter():
                                if mark.tag.rpartition("}")[2] == "Placemark":
                                    found = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in mark.iter()}
                                    out.append((found.get("name"), found.get("styleUrl"), found.get("coordinates")))
            yield pd.DataFrame(out, columns=["name", "style", "at"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "name string, style string, at string")
    at = F.split("at", ",")
    return rows.select("name", "style", _double(F.try_element_at(at, F.lit(2))).alias("lat"), _double(F.try_element_at(at, F.lit(1))).alias("lon")).where(F.coalesce(valid(F.col("lat"), F.col("lon")), F.lit(False)))


def read_sites_json(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lon, type, date and region of a document {"sites": [...]}; lng stands in for a missing lon."""
    one = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "lat", "lon", "lng", "type", "date", "region")])
    doc = spark.read.schema(T.StructType([T.StructField("sites", T.ArrayType(one))])).json(path, multiLine=True)
    s = doc.select(F.explode("sites").alias("s")).select("s.*")
    return s.select("name", _double(F.col("lat")).alias("lat"), _double(F.coalesce("lon", "lng")).alias("lon"), "type", "date", "region").where(F.coalesce(valid(F.col("lat"), F.col("lon"), True), F.lit(False)))


def read_measurements_json(spark: SparkSession, path: str, most_bp: float = 50_000) -> DataFrame:
    """site, lat, lon and bp of records [{"measurement": {bp, lat, lng, site}}] with 0 < bp <= most_bp."""
    m = T.StructType([T.StructField(c, T.StringType()) for c in ("bp", "lat", "lng", "site")])
    rows = spark.read.schema(T.StructType([T.StructField("measurement", m)])).json(path, multiLine=True).select("measurement.*")
    out = rows.select("site", _double(F.col("lat")).alias("lat"), _double(F.col("lng")).alias("lon"), _double(F.col("bp")).alias("bp"))
    return out.where(F.coalesce(valid(F.col("lat"), F.col("lon")) & (F.col("bp") > 0) & (F.col("bp") <= most_bp), F.lit(False)))


def read_geojson(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """lat, lon and the asked properties of a FeatureCollection's points."""
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    feature = T.StructType([T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])), T.StructField("properties", props)])
    rows = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).json(path, multiLine=True).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return rows.where(F.col("f.geometry.type") == "Point").select(F.try_element_at(at, F.lit(2)).alias("lat"), F.try_element_at(at, F.lit(1)).alias("lon"), *[F.col(f"f.properties.{p}").alias(p) for p in properties])


def read_raster(spark: SparkSession, path: str, rows: int, cols: int, dtype: str = ">u2", skip: int = 0, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """row, col and value of plain binary grids; a file is one task and yields its rows in blocks."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                grid = np.frombuffer(content, dtype=dtype, count=rows * cols, offset=skip).reshape(rows, cols)
                for a in range(0, rows, 64):
                    part = grid[a : a + 64]
                    r, c = np.indices(part.shape)
                    yield pd.DataFrame({"row": (r + a).ravel().astype("int32"), "col": c.ravel().astype("int32"), "value": part.ravel().astype(float) * scale + offset})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "row int, col int, value double")


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; NaN and infinite numbers as null, since JSON has none."""
    clean = {f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df.withColumns(clean).write.mode("overwrite").option("ignoreNullFields", "false").json(path) if clean else df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_xlsx(spark: SparkSession, path: str, sheet: str, columns: dict[str, int]) -> DataFrame:
    """Cells of a named sheet by position (name -> column from 0), as strings, without the first row; a file is one task."""
    import re
    import xml.etree.ElementTree as ET

    def local(e):
        return e.tag.rpartition("}")[2]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
                    names = [e.get("name") for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
                    if sheet not in names:
                        continue
                    rows = [e for e in ET.fromstring(z.read(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml")).iter() if local(e) == "row"]
                    for row in rows[1:]:
                        cells = {}
                        for c in row:
                            letters = re.match(r"[A-Z]+", c.get("r", "A")).group()
                            at = 0
                            for ch in letters:
                                at = at * 26 + ord(ch) - 64
                            text = "".join(v.text or "" for v in c.iter() if local(v) in ("v", "t"))
                            cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text or None
                        out.append([cells.get(k) for k in columns.values()])
            yield pd.DataFrame(out, columns=list(columns))

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, schema)


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """shape, part, vertex, lat and lon of points, polylines and polygons in .shp files, one task a file."""
    import struct

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                out, at, shape = [], 100, 0
                while at + 12 <= len(content):
                    size = struct.unpack(">i", content[at + 4 : at + 8])[0] * 2
                    body = content[at + 8 : at + 8 + size]
                    kind = struct.unpack("<i", body[:4])[0]
                    if kind in (1, 11, 21):
                        x, y = struct.unpack("<2d", body[4:20])
                        out.append((shape, 0, 0, y, x))
                    elif kind in (3, 5, 13, 15, 23, 25):
                        parts, points = struct.unpack("<2i", body[36:44])
                        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
                        xy = np.frombuffer(body, dtype="<f8", count=2 * points, offset=44 + 4 * parts).reshape(-1, 2)
                        out += [(shape, p, v - starts[p], float(xy[v, 1]), float(xy[v, 0])) for p in range(parts) for v in range(starts[p], starts[p + 1])]
                    shape += 1
                    at += 8 + size
                yield pd.DataFrame(out, columns=["shape", "part", "vertex", "lat", "lon"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "shape int, part int, vertex int, lat double, lon double")
