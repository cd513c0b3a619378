"""Many great circles against all points: a stated set of poles, in blocks, against every row.

A point lies within d km of a circle if |s.p| <= sin(d / R) for its unit vector s and the pole p, so a batch of points and a
block of poles are one matrix product. Each task adds up its counts before anything is shuffled; what moves is one row for
each task, pole and class. Poles are broadcast up to MAX_POLES, a set given by the caller that does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.functions.geo import EARTH_RADIUS_KM, band_sine, unit_x, unit_y, unit_z

MAX_POLES = 1_000_000
BLOCK = 2_000_000


def unit_vectors(lat, lon) -> np.ndarray:
    la, lo = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def pole_counts(points: DataFrame, poles: list[tuple[int, float, float]], km: float | list[float], cls: str | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """pole_id, km, cls (null without a class column) and n: how many points of a class lie within km of each circle.

    poles: (id, latitude, longitude). Points with null or NaN coordinates count nowhere; a null class is a class of its own;
    circles without points come out with 0 only for classes that occur at all; no points give no rows.
    """
    if len(poles) > MAX_POLES:
        raise ValueError(f"more than {MAX_POLES} poles in one scan")
    ids = np.array([p[0] for p in poles], dtype=np.int64)
    vectors = unit_vectors([p[1] for p in poles], [p[2] for p in poles]).T
    reach = [float(k) for k in (km if isinstance(km, (list, tuple)) else [km])]
    sines = [band_sine(k) for k in reach]
    shared = points.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        sums: dict[object, np.ndarray] = {}
        for b in batches:
            for c, part in b.groupby("cls", dropna=False, sort=False):
                c = None if pd.isna(c) else c
                total = sums.setdefault(c, np.zeros((len(sines), len(ids)), dtype=np.int64))
                xyz = part[["x", "y", "z"]].to_numpy()
                step = max(1, BLOCK // max(len(xyz), 1))
                for a in range(0, len(ids), step):
                    dot = np.abs(xyz @ vectors[:, a : a + step])
                    for k, s in enumerate(sines):
                        total[k, a : a + step] += np.count_nonzero(dot <= s, axis=0)
        for c, total in sums.items():
            for k, d in enumerate(reach):
                yield pd.DataFrame({"pole_id": ids, "km": d, "cls": pd.Series([c] * len(ids), dtype="object"), "n": total[k]})

    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    slim = points.where(la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo)).select(unit_x(la, lo).alias("x"), unit_y(la, lo).alias("y"), unit_z(la).alias("z"), (F.col(cls).cast("string") if cls else F.lit(None).cast("string")).alias("cls"))
    return slim.mapInPandas(run, "pole_id bigint, km double, cls string, n bigint").groupBy("pole_id", "km", "cls").agg(F.sum("n").alias("n"))


def split_counts(points: DataFrame, poles: list[tuple[int, float, float]], km: float, halves: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """split, pole_id, fitted and tested: points within km of each circle in half 0 and in half 1 of each split.

    halves: an array column with the half, 0 or 1, of a point in each split, of one length for all points. Distances are
    computed once for all splits; points with null or NaN coordinates count nowhere; no points give no rows.
    """
    if len(poles) > MAX_POLES:
        raise ValueError(f"more than {MAX_POLES} poles in one scan")
    sine = band_sine(km)
    shared = points.sparkSession.sparkContext.broadcast((np.array([p[0] for p in poles], dtype=np.int64), unit_vectors([p[1] for p in poles], [p[2] for p in poles]).T))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        total = None
        for b in batches:
            if not len(b):
                continue
            # whole numbers below 2^24 are exact in single precision, far above the rows of a batch
            tested = np.stack(b["halves"].to_numpy()).T.astype(np.float32)
            if total is None:
                total = np.zeros((2, len(tested), len(ids)), dtype=np.int64)
            xyz = b[["x", "y", "z"]].to_numpy()
            step = max(1, BLOCK // len(xyz))
            for a in range(0, len(ids), step):
                near = (np.abs(xyz @ vectors[:, a : a + step]) <= sine).astype(np.float32)
                second = (tested @ near).astype(np.int64)
                total[0, :, a : a + step] += near.sum(axis=0, dtype=np.float64).astype(np.int64) - second
                total[1, :, a : a + step] += second
        for split in range(0 if total is None else total.shape[1]):
            yield pd.DataFrame({"split": split, "pole_id": ids, "fitted": total[0, split], "tested": total[1, split]})

    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    slim = points.where(la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo)).select(unit_x(la, lo).alias("x"), unit_y(la, lo).alias("y"), unit_z(la).alias("z"), F.col(halves).cast("array<tinyint>").alias("halves"))
    return slim.mapInPandas(run, "split bigint, pole_id bigint, fitted bigint, tested bigint").groupBy("split", "pole_id").agg(F.sum("fitted").alias("fitted"), F.sum("tested").alias("tested"))


def pole_grid(step: float, hemisphere: bool = True) -> list[tuple[int, float, float]]:
    """A grid of poles; antipodal poles have the same circle, so that one hemisphere is enough."""
    lats = np.arange(0.0 if hemisphere else -90.0, 90.0 + 1e-9, step)
    lons = np.arange(-180.0, 180.0, step)
    return [(i * len(lons) + j, float(a), float(o)) for i, a in enumerate(lats) for j, o in enumerate(lons)]


def ring_counts(points: DataFrame, centres: list[tuple[int, float, float]], low_deg: float, high_deg: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """centre_id and n: how many points lie between two angular distances (closed) of each of a stated set of centres.

    The same blocks as in pole_counts; points with null or NaN coordinates count nowhere; no points give no rows.
    """
    if len(centres) > MAX_POLES:
        raise ValueError(f"more than {MAX_POLES} centres in one scan")
    top, bottom = float(np.cos(np.radians(low_deg))), float(np.cos(np.radians(high_deg)))
    shared = points.sparkSession.sparkContext.broadcast((np.array([c[0] for c in centres], dtype=np.int64), unit_vectors([c[1] for c in centres], [c[2] for c in centres]).T))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        total = np.zeros(len(ids), dtype=np.int64)
        seen = False
        for b in batches:
            seen |= len(b) > 0
            xyz = b[["x", "y", "z"]].to_numpy()
            step = max(1, BLOCK // max(len(xyz), 1))
            for a in range(0, len(ids), step):
                dot = xyz @ vectors[:, a : a + step]
                total[a : a + step] += np.count_nonzero((dot <= top) & (dot >= bottom), axis=0)
        if seen:
            yield pd.DataFrame({"centre_id": ids, "n": total})

    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    slim = points.where(la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo)).select(unit_x(la, lo).alias("x"), unit_y(la, lo).alias("y"), unit_z(la).alias("z"))
    return slim.mapInPandas(run, "centre_id bigint, n bigint").groupBy("centre_id").agg(F.sum("n").alias("n"))


def circles_through(points: list[tuple[int, float, float]], second: tuple[float, float]) -> list[tuple[int, float, float]]:
    """Poles of the circles through each point and a second one, by cross products; coinciding points are left out."""
    a, b = unit_vectors([p[1] for p in points], [p[2] for p in points]), unit_vectors([second[0]], [second[1]])[0]
    n = np.cross(a, b)
    size = np.linalg.norm(n, axis=1)
    out = []
    for (i, _, _), v, s in zip(points, n, size):
        if s > 1e-12:
            v = v / s * (1 if v[2] >= 0 else -1)
            out.append((i, float(np.degrees(np.arcsin(np.clip(v[2], -1, 1)))), float(np.degrees(np.arctan2(v[1], v[0])))))
    return out


def through_box(poles: DataFrame, south: float, north: float, west: float, east: float, samples: int = 360) -> DataFrame:
    """pole_id, lat and lon of the poles whose circle, sampled at equal bearings, has a point in a closed box."""
    from arcspan.functions.geo import point_lat, point_lon

    b = poles.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("__b", F.col("__b") * (360.0 / samples))
    la, lo = point_lat(F.col("__b"), F.col("lat")), point_lon(F.col("__b"), F.col("lat"), F.col("lon"), wrapped=True)
    return b.where(la.between(south, north) & lo.between(west, east)).select("pole_id", "lat", "lon").distinct()


def pole_errors(points: DataFrame, poles: list[tuple[int, float, float]], by: str | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """pole_id, cls, n, mean_km, rms_km and max_km of the distances of the points of a group to each circle, in blocks."""
    if len(poles) > MAX_POLES:
        raise ValueError(f"more than {MAX_POLES} poles in one scan")
    shared = points.sparkSession.sparkContext.broadcast((np.array([p[0] for p in poles], dtype=np.int64), unit_vectors([p[1] for p in poles], [p[2] for p in poles]).T))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        sums: dict[object, list] = {}
        for b in batches:
            for c, part in b.groupby("cls", dropna=False, sort=False):
                c = None if pd.isna(c) else c
                s = sums.setdefault(c, [0, np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))])
                xyz = part[["x", "y", "z"]].to_numpy()
                s[0] += len(xyz)
                step = max(1, BLOCK // max(len(xyz), 1))
                for a in range(0, len(ids), step):
                    km = EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.abs(xyz @ vectors[:, a : a + step])))
                    s[1][a : a + step] += km.sum(axis=0)
                    s[2][a : a + step] += (km * km).sum(axis=0)
                    s[3][a : a + step] = np.maximum(s[3][a : a + step], km.max(axis=0))
        for c, (n, one, two, top) in sums.items():
            yield pd.DataFrame({"pole_id": ids, "cls": pd.Series([c] * len(ids), dtype="object"), "n": n, "one": one, "two": two, "top": top})

    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    slim = points.where(la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo)).select(unit_x(la, lo).alias("x"), unit_y(la, lo).alias("y"), unit_z(la).alias("z"), (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("cls"))
    s = slim.mapInPandas(run, "pole_id bigint, cls string, n bigint, one double, two double, top double").groupBy("pole_id", "cls").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"), F.max("top").alias("max_km"))
    return s.select("pole_id", "cls", "n", (F.col("one") / F.col("n")).alias("mean_km"), F.sqrt(F.col("two") / F.col("n")).alias("rms_km"), "max_km")


def best_pole(points: DataFrame, by: str = "rms_km", levels: int = 5, step: float = 10.0) -> tuple[float, float, float] | None:
    """Latitude, longitude and error of the circle with the least mean_km, rms_km or max_km, from coarse to fine grids.

    Each level scans a stated grid around the best pole so far, a third as wide; None without points.
    """
    grid = pole_grid(step)
    found = None
    for _ in range(levels):
        best = pole_errors(points, grid).orderBy(by, "pole_id").first()
        if best is None:
            return None
        _, lat, lon = grid[best["pole_id"]]
        found = (lat, lon, best[by])
        step /= 3.0
        wide = 1.0 / max(np.cos(np.radians(lat)), 0.02)
        grid = [(i * 7 + j, float(max(-90.0, min(90.0, lat + (i - 3) * step))), float(lon + (j - 3) * step * wide)) for i in range(7) for j in range(7)]
    return found
