"""Polylines: segments, crossings with circles, deviation from straight courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcspan.functions.geo import circle_km, haversine_km, segment_crossing


def segments(vertices: DataFrame, line: str, order: str, longest_lon: float = 180.0) -> DataFrame:
    """line, order, lat, lon, lat2 and lon2 of each segment; those that jump more than longest_lon are cut by the antimeridian and left out."""
    w = Window.partitionBy(line).orderBy(order)
    s = vertices.select(line, order, "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    return s.where(F.col("lat2").isNotNull() & F.col("lon2").isNotNull() & (F.abs(F.col("lon2") - F.col("lon")) <= longest_lon))


def crossings(vertices: DataFrame, line: str, order: str) -> DataFrame:
    """line, order, lat and lon of each point where a polyline crosses the default circle."""
    meets, lat, lon = segment_crossing("lat", "lon", "lat2", "lon2")
    return segments(vertices, line, order).where(meets).select(line, order, lat.alias("lat"), lon.alias("lon"))


def lengths(vertices: DataFrame, line: str, order: str) -> DataFrame:
    """line, km, points and rms_circle_km (of its vertices to the default circle) of each polyline."""
    w = Window.partitionBy(line).orderBy(order)
    step = F.coalesce(haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"), F.lit(0.0))
    return vertices.withColumns({"__s": step, "__d": circle_km("lat", "lon")}).groupBy(line).agg(F.sum("__s").alias("km"), F.count("*").alias("points"), F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("rms_circle_km"))


def straight_deviation(vertices: DataFrame, line: str, order: str) -> DataFrame:
    """line and rms_km of the inner vertices from where they were to be between the line's ends, 0 without inner ones.

    A vertex is to be as far along, in degrees, as its distance from the start is a share of its distances to both ends.
    """
    w, all_of = Window.partitionBy(line).orderBy(order), Window.partitionBy(line)
    ends = lambda c: (F.min_by(c, order).over(all_of), F.max_by(c, order).over(all_of))
    (la0, la1), (lo0, lo1) = ends("lat"), ends("lon")
    v = vertices.withColumns({"__k": F.row_number().over(w), "__n": F.count("*").over(all_of), "__la0": la0, "__la1": la1, "__lo0": lo0, "__lo1": lo1})
    start, end = haversine_km("__la0", "__lo0", "lat", "lon"), haversine_km("lat", "lon", "__la1", "__lo1")
    share = F.when(haversine_km("__la0", "__lo0", "__la1", "__lo1") > 0, F.try_divide(start, start + end)).otherwise(0.5)
    d = haversine_km("lat", "lon", F.col("__la0") + (F.col("__la1") - F.col("__la0")) * share, F.col("__lo0") + (F.col("__lo1") - F.col("__lo0")) * share)
    inner = F.when((F.col("__k") > 1) & (F.col("__k") < F.col("__n")), F.col("__d") * F.col("__d"))
    return v.withColumn("__d", d).groupBy(line).agg(F.coalesce(F.sqrt(F.avg(inner)), F.lit(0.0)).alias("rms_km"))
