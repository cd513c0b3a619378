"""Rasters as rows (row, col, value) and points sampled from them by equi-joins on integer cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_cell(points: DataFrame, grid: DataFrame, degrees: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds value of the cell whose node is nearest, halves to the even one; rows run from +90 south, columns wrap."""
    cols = round(360.0 / degrees)
    out = points.withColumns({"row": F.bround((90.0 - F.col(lat)) / degrees, 0).cast("int"), "col": F.pmod(F.bround((F.col(lon) + 180.0) / degrees, 0).cast("int"), F.lit(cols))})
    return out.join(grid.select("row", "col", "value"), ["row", "col"], "left").drop("row", "col")


def bilinear(points: DataFrame, grid: DataFrame, degrees: float, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """key and value between the four nodes around each point; columns wrap at 360 degrees, rows stop at the poles.

    Each point becomes four weighted rows that meet the grid in one equi-join. A point with a missing node gets null.
    """
    rows, cols = round(180.0 / degrees) + 1, round(360.0 / degrees)
    y, x = (90.0 - F.col(lat)) / degrees, (F.col(lon) + 180.0) / degrees
    top = F.least(F.floor(y), F.lit(rows - 2))
    fy, fx = y - top, x - F.floor(x)
    corner = lambda dy, dx: F.struct((top + dy).cast("int").alias("row"), F.pmod(F.floor(x) + dx, F.lit(cols)).cast("int").alias("col"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
    four = points.select(key, F.explode(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)])).alias("c")).select(key, "c.*")
    return four.join(grid.select("row", "col", "value"), ["row", "col"], "left").groupBy(key).agg(F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value"))).alias("value"))


def gradient(grid: DataFrame) -> DataFrame:
    """row, col and slope: length of the Sobel gradient of each cell with all eight neighbours, by windows along columns."""
    w = Window.partitionBy("col").orderBy("row")
    whole = (F.lag("row").over(w) == F.col("row") - 1) & (F.lead("row").over(w) == F.col("row") + 1)
    lines = grid.withColumns({"smooth": F.when(whole, F.lag("value").over(w) + 2 * F.col("value") + F.lead("value").over(w)), "diff": F.when(whole, F.lead("value").over(w) - F.lag("value").over(w))})
    h = Window.partitionBy("row").orderBy("col")
    beside = (F.lag("col").over(h) == F.col("col") - 1) & (F.lead("col").over(h) == F.col("col") + 1)
    gx = F.lead("smooth").over(h) - F.lag("smooth").over(h)
    gy = F.lag("diff").over(h) + 2 * F.col("diff") + F.lead("diff").over(h)
    return lines.withColumn("slope", F.when(beside, F.sqrt(gx * gx + gy * gy))).where("slope is not null").select("row", "col", "slope")


def focal(grid: DataFrame, reach: int) -> DataFrame:
    """row, col, value, mean, lowest and highest of the square of cells within reach, columns not wrapped: two separable passes."""
    lines = Window.partitionBy("col").orderBy("row").rangeBetween(-reach, reach)
    down = grid.withColumns({"s": F.sum("value").over(lines), "n": F.count("value").over(lines), "lo": F.min("value").over(lines), "hi": F.max("value").over(lines)})
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-reach, reach)
    return down.select("row", "col", "value", (F.sum("s").over(across) / F.sum("n").over(across)).alias("mean"), F.min("lo").over(across).alias("lowest"), F.max("hi").over(across).alias("highest"))


def position_index(grid: DataFrame, reach: int) -> DataFrame:
    """row, col and tpi (value over the mean around)."""
    return focal(grid, reach).select("row", "col", (F.col("value") - F.col("mean")).alias("tpi"))


def prominence(points: DataFrame, grid: DataFrame, step: float, key: str, km: float = 25.0, directions: int = 64, rings: tuple[float, ...] = (0.33, 0.67, 1.0), lowest: float = -100.0, least: int = 10) -> DataFrame:
    """key and prominence: the ground at a point over the mean of what lies around it on rings, both from the nearest cells.

    Ground under 0 around counts as 0, ground of at most lowest not at all. Null at sea (a point's ground at most 0) and
    where fewer than least places around are known. keys must be unique.

    The places are the side of the join that is kept whole, so that Spark, which takes them for as few as the points before they
    are exploded, broadcasts the grid or nothing. A broadcast leaves the places of a point in order, direction by direction,
    and their sum is made in that order; after a shuffle its last bits may vary.
    """
    around = F.array(*[F.struct(F.lit(f * km * math.sin(2 * math.pi * k / directions)).alias("up"), F.lit(f * km * math.cos(2 * math.pi * k / directions)).alias("right")) for k in range(directions) for f in rings])
    wide = F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    spread = points.select(F.col(key).alias("id"), "lat", "lon", F.explode(around).alias("o"))
    spread = spread.select("id", (F.col("lat") + F.col("o.up") / 111.0).alias("lat"), (F.pmod(F.col("lon") + F.col("o.right") / (111.0 * wide) + 180.0, F.lit(360.0)) - 180.0).alias("lon")).where(F.col("lat").between(-90, 90))
    ground = F.when(F.col("value") > lowest, F.greatest("value", F.lit(0.0)))  # not a filter, which would make the outer join an inner one
    seen = nearest_cell(spread, grid, step).groupBy("id").agg(F.avg(ground).alias("mean"), F.count(ground).alias("n"))
    own = nearest_cell(points.select(F.col(key).alias("id"), "lat", "lon"), grid, step).select("id", F.col("value").alias("own"))
    out = own.join(seen, "id", "left")
    return out.select(F.col("id").alias(key), F.when((F.col("own") > 0) & (F.col("n") >= least), F.col("own") - F.col("mean")).alias("prominence"))


def suitability(layers: list[tuple[DataFrame, float]]) -> DataFrame:
    """row, col and value: the weighted sum of layers of one grid; a cell that a layer lacks is left out."""
    out = None
    for layer, weight in layers:
        part = layer.select("row", "col", (F.col("value") * weight).alias("part"))
        out = part.withColumnRenamed("part", "value") if out is None else out.join(part, ["row", "col"]).select("row", "col", (F.col("value") + F.col("part")).alias("value"))
    return out
