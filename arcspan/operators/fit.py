"""Circles fitted to points, and shapes compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.functions.geo import EARTH_RADIUS_KM, unit_x, unit_y, unit_z


def fit_pole(points: DataFrame, by: list[str], centred: bool = False) -> DataFrame:
    """pole_lat, pole_lon (northern) and rms_km by group: the direction with the least second moment of unit vectors.

    The moments are summed in the JVM, so only ten numbers a group reach Python, whatever the group's size. centred fits
    the plane through the points instead of one through the earth's centre. Fewer than two points give nulls.
    """
    v = {"x": unit_x("lat", "lon"), "y": unit_y("lat", "lon"), "z": unit_z("lat")}
    names = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(v[a] * v[b]).alias(a + b) for a, b in names], *[F.sum(e).alias("s" + k) for k, e in v.items()])
    kinds = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by)

    def solve(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
                if centred:
                    s = np.array([r.sx, r.sy, r.sz])
                    m = m - np.outer(s, s) / r.n
                values, vectors = np.linalg.eigh(m)
                p = vectors[:, 0] * (1 if vectors[2, 0] >= 0 else -1)
                ok = r.n >= 2
                out.append((np.degrees(np.arcsin(np.clip(p[2], -1, 1))) if ok else None, np.degrees(np.arctan2(p[1], p[0])) if ok else None, float(np.sqrt(max(values[0], 0) / r.n) * EARTH_RADIUS_KM) if ok else None))
            yield pd.concat([b[[*by, "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["pole_lat", "pole_lon", "rms_km"])], axis=1)

    return sums.mapInPandas(solve, (kinds + ", " if by else "") + "n bigint, pole_lat double, pole_lon double, rms_km double")


def procrustes(df: DataFrame, x1: str, y1: str, x2: str, y2: str, by: list[str]) -> DataFrame:
    """disparity by group of two planar point sets given row by row, after translation, scaling and rotation or reflection.

    In closed form from second moments: the singular values of a 2 x 2 matrix sum to sqrt(|M|^2 + 2 |det M|).
    """
    cov = lambda a, b: F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double"))
    s = df.groupBy(*by).agg(
        F.count("*").alias("n"), (cov(x1, x1) + cov(y1, y1)).alias("va"), (cov(x2, x2) + cov(y2, y2)).alias("vb"), cov(x1, x2).alias("a"), cov(x1, y2).alias("b"), cov(y1, x2).alias("c"), cov(y1, y2).alias("d")
    )
    a, b, c, d = map(F.col, "abcd")
    trace = F.sqrt(a * a + b * b + c * c + d * d + 2 * F.abs(a * d - b * c))
    return s.select(*by, "n", (1 - F.try_divide(trace * trace, F.col("va") * F.col("vb"))).alias("disparity"))


def long_axis(df: DataFrame, by: list[str], lat: str, lon: str) -> DataFrame:
    """bearing_deg (0 to 180) and elongation of each group's points, by the eigenvalues of their covariance in local km."""
    s = df.groupBy(*by).agg(F.avg(lat).alias("__la"), F.var_pop(F.col(lat)).alias("vy"), F.var_pop(F.col(lon)).alias("vx"), F.covar_pop(lon, lat).alias("vxy"), F.count("*").alias("n"))
    k = F.cos(F.radians("__la"))
    vx, vy, vxy = F.col("vx") * k * k, F.col("vy"), F.col("vxy") * k
    spread = F.sqrt((vx - vy) ** 2 + 4 * vxy**2)
    return s.select(*by, "n", F.pmod(F.degrees(0.5 * F.atan2(2 * vxy, vy - vx)), F.lit(180.0)).alias("bearing_deg"), F.sqrt(F.try_divide(vx + vy + spread, vx + vy - spread)).alias("elongation"))


def fitted_to_draws(points: DataFrame, rows: int, trials: int, size: int, km: float, seed: int = 101) -> DataFrame:
    """trial, pole_lat, pole_lon, rms_km and n: circles fitted to so many drawn points, and how many of all points lie within km.

    points: row (0 to rows - 1), lat, lon. Draws are by hash, with repetition; the poles are a stated number of trials.
    """
    from arcspan.operators.nulls import draw_int
    from arcspan.operators.poles import pole_counts

    spark = points.sparkSession
    slots = spark.range(trials * size).select(F.floor(F.col("id") / size).alias("trial"), F.pmod("id", F.lit(size)).alias("slot"))
    drawn = slots.select("trial", F.pmod(draw_int(seed, F.col("trial"), F.col("slot")), F.lit(rows)).alias("row")).join(points.select("row", "lat", "lon"), "row")
    fits = [(r["trial"], r["pole_lat"], r["pole_lon"], r["rms_km"]) for r in fit_pole(drawn, ["trial"]).where("pole_lat is not null").collect()]
    counts = pole_counts(points, [f[:3] for f in fits], km).select(F.col("pole_id").alias("trial"), "n")
    return spark.createDataFrame(fits, "trial bigint, pole_lat double, pole_lon double, rms_km double").join(counts, "trial")
