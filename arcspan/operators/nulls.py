"""Random draws as data: every draw is a hash of (seed, trial, row), so that results do not depend on partitions.

The generator squares between two congruential steps on 31 bits, as linear steps alone would leave draws of neighbouring
seeds at a fixed distance; products stay below 2^63, so that any SQL engine can repeat it. Trials are rows: sites are replicated by trial where they lie, and only index draws, which need the value of
another row, are joined, on the row number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspan.functions.geo import circle_km
from arcspan.operators.ranking import rank_within

M31 = 2_147_483_647
A1, A2 = 48_271, 69_621
JITTER_DEG = 2.0


def draw_int(seed: int, trial: Column, row: Column) -> Column:
    """A whole number in [0, 2^31 - 1)."""
    x = F.pmod(trial * 7919 + row * 104_729 + F.lit(seed * 15_485_863), F.lit(M31))
    y = F.pmod(x * A1, F.lit(M31))
    return F.pmod(F.pmod(y * y, F.lit(M31)) * A2 + y, F.lit(M31))


def draw_int_sql(seed: int, trial: str, row: str) -> str:
    y = f"((({trial} * 7919 + {row} * 104729 + {seed * 15_485_863}) % {M31}) * {A1} % {M31})"
    return f"((({y} * {y}) % {M31} * {A2} + {y}) % {M31})"


def uniform(seed: int, trial: Column, row: Column) -> Column:
    """In (0, 1)."""
    return (draw_int(seed, trial, row) + 0.5) / float(M31)


def uniform_sql(seed: int, trial: str, row: str) -> str:
    return f"(({draw_int_sql(seed, trial, row)} + 0.5) / {float(M31)})"


def normal(seed: int, trial: Column, row: Column) -> Column:
    """Standard normal, by Box and Muller from two uniforms."""
    return F.sqrt(-2.0 * F.ln(uniform(seed, trial, row))) * F.cos(2.0 * math.pi * uniform(seed + 1, trial, row))


def normal_sql(seed: int, trial: str, row: str) -> str:
    return f"(sqrt(-2.0 * ln({uniform_sql(seed, trial, row)})) * cos({2.0 * math.pi!r} * {uniform_sql(seed + 1, trial, row)}))"


def trials_of(df: DataFrame, trials: int) -> DataFrame:
    """Every row in every trial; the rows stay where they are."""
    return df.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))))


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Row numbers from 0 by the order columns, without a single-partition sort."""
    return rank_within(df.withColumn("__all", F.lit(0)), ["__all"], order, order, name).drop("__all")


def drawn_from(slots: DataFrame, sites: DataFrame, on: str) -> DataFrame:
    """Slots with the site that each draws. Both sides are sorted: Spark takes exploded trials to be as small as the sites and would broadcast them."""
    return slots.hint("merge").join(sites, on)


def matched_points(sites: DataFrame, trials: int, rows: int, joint: bool = True, clamp: bool = True, jitter: float = JITTER_DEG, seed: int = 42) -> DataFrame:
    """trial, row, lat and lon of the distribution-matched null: coordinates of drawn sites plus Gaussian jitter.

    sites: row (0 to rows - 1), lat, lon. Joint: both coordinates come from one drawn site; else each from its own, which
    loses how they go together. Clamped to the usual ranges, longitudes held at 180, not wrapped, where clamp is set.
    """
    slots = trials_of(sites.select("row"), trials)
    slots = slots.withColumn("i", F.pmod(draw_int(seed, F.col("trial"), F.col("row")), F.lit(rows)))
    drawn = drawn_from(slots, sites.select(F.col("row").alias("i"), "lat", "lon"), "i")
    if not joint:
        other = drawn.drop("lon", "i").withColumn("j", F.pmod(draw_int(seed + 7, F.col("trial"), F.col("row")), F.lit(rows)))
        drawn = drawn_from(other, sites.select(F.col("row").alias("j"), "lon"), "j")
    lat = F.col("lat") + jitter * normal(seed + 2, F.col("trial"), F.col("row"))
    lon = F.col("lon") + jitter * normal(seed + 4, F.col("trial"), F.col("row"))
    if clamp:
        lat, lon = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)), F.greatest(F.lit(-180.0), F.least(F.lit(180.0), lon))
    return drawn.select("trial", "row", lat.alias("lat"), lon.alias("lon"))


def random_poles(poles: DataFrame, seed: int = 42, north: bool = False) -> DataFrame:
    """pole_id, lat and lon of uniform poles; poles: pole_id. North: upper hemisphere only, which has all circles."""
    z = uniform(seed, F.col("pole_id"), F.lit(0)) if north else 2.0 * uniform(seed, F.col("pole_id"), F.lit(0)) - 1.0
    return poles.select("pole_id", F.degrees(F.asin(z)).alias("lat"), (360.0 * uniform(seed + 1, F.col("pole_id"), F.lit(0)) - 180.0).alias("lon"))


def corridor_counts(points: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """by, km and n: points within each distance of the default circle, all thresholds in one pass."""
    d = circle_km("lat", "lon")
    wide = points.select(*by, d.alias("__d")).groupBy(*by).agg(*[F.count_if(F.col("__d") <= t).alias(f"n{k}") for k, t in enumerate(thresholds)])
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(float(t)).alias("km"), F.col(f"n{k}").alias("n")) for k, t in enumerate(thresholds)])).alias("x")).select(*by, "x.km", "x.n")


def null_summary(observed: DataFrame, null: DataFrame, by: list[str], trials: int, floor_sigma: float = 0.0) -> DataFrame:
    """Observed count against its null: mu, sigma (population), z (0 for sigma 0), enrichment (null for mu 0) and p.

    observed: by, n; null: trial, by, n, where a trial without a row counts as 0. p: share of trials at least as high.
    """
    stats = null.join(observed.select(*by, F.col("n").alias("__obs")), by).groupBy(*by).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.count_if(F.col("n") >= F.col("__obs")).alias("ge"), F.count("*").alias("rows"))
    mu = F.coalesce(F.col("s"), F.lit(0)) / trials
    sigma = F.greatest(F.lit(floor_sigma), F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.col("ss"), F.lit(0)) / trials - mu * mu)))
    ge = F.coalesce("ge", F.lit(0)) + F.when(F.col("n") == 0, trials - F.coalesce("rows", F.lit(0))).otherwise(0)
    out = observed.join(stats, by, "left").withColumns({"mu": mu, "sigma": sigma, "p": ge / trials})
    return out.select(*by, F.col("n").alias("observed"), "mu", "sigma", F.when(F.col("sigma") > 1e-12, (F.col("n") - F.col("mu")) / F.col("sigma")).otherwise(0.0).alias("z"), F.try_divide(F.col("n").cast("double"), F.col("mu")).alias("enrichment"), "p")


def latitude_matched_poles(spark, trials: int, low: float, high: float, attempts: int = 1000, seed: int = 42) -> DataFrame:
    """trial, attempt, lat and lon: the first uniform pole of each trial whose circle covers at least half of a range of latitudes.

    A circle reaches 90 less its pole's latitude on both sides of the equator. Where no attempt does, one more is taken as it is.
    """
    tries = trials_of(spark.range(attempts + 1).select(F.col("id").alias("attempt")), trials)
    u = lambda k: uniform(k, F.col("trial"), F.col("attempt"))
    poles = tries.select("trial", "attempt", F.degrees(F.asin(2.0 * u(seed) - 1.0)).alias("lat"), (360.0 * u(seed + 1) - 180.0).alias("lon"))
    top = 90.0 - F.abs("lat")
    shared = F.least(top, F.lit(high)) - F.greatest(-top, F.lit(low))
    good = poles.where((F.col("attempt") == attempts) | (shared > 0) & (shared >= 0.5 * (high - low)))
    return good.groupBy("trial").agg(F.min_by(F.struct("attempt", "lat", "lon"), "attempt").alias("x")).select("trial", "x.*")


def class_nulls(sites: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """cls, trial, row, lat and lon: the joint distribution-matched null of each class by itself.

    sites: cls, id, lat, lon. Each class draws from its own rows, as many as it has.
    """
    numbered_ = rank_within(sites.select("cls", "id", "lat", "lon"), ["cls"], ["id"], ["id"], "row")
    sizes = numbered_.groupBy("cls").agg(F.count("*").alias("__n"))
    slots = trials_of(numbered_.select("cls", "row"), trials).join(F.broadcast(sizes), "cls")
    drawn = slots.withColumn("i", F.pmod(draw_int(seed, F.col("trial"), F.col("row")), F.col("__n"))).join(numbered_.select("cls", F.col("row").alias("i"), "lat", "lon"), ["cls", "i"])
    jitter = lambda c, k, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c) + JITTER_DEG * normal(seed + k, F.col("trial"), F.col("row"))))
    return drawn.select("cls", "trial", "row", jitter("lat", 2, 90.0).alias("lat"), jitter("lon", 4, 180.0).alias("lon"))


def poles_near(sites: DataFrame, rows: int, poles: int, seed: int = 42, spread: float = 10.0) -> DataFrame:
    """pole_id, lat and lon: poles drawn around sites (row, lat, lon), latitude and longitude each from its own, by Gaussian jitter."""
    p = sites.sparkSession.range(poles).select(F.col("id").alias("pole_id"))
    pick = lambda k: F.pmod(draw_int(seed + k, F.col("pole_id"), F.lit(0)), F.lit(rows))
    p = p.withColumns({"i": pick(0), "j": pick(1)})
    p = p.join(sites.select(F.col("row").alias("i"), F.col("lat").alias("la")), "i").join(sites.select(F.col("row").alias("j"), F.col("lon").alias("lo")), "j")
    lat = F.col("la") + spread * normal(seed + 2, F.col("pole_id"), F.lit(0))
    lon = F.col("lo") + spread * normal(seed + 4, F.col("pole_id"), F.lit(0))
    return p.select("pole_id", F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)).alias("lat"), (F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("lon"))


def gaussian_cloud(spark, trials: int, rows: int, centre: tuple[float, float], spread: tuple[float, float], seed: int = 42) -> DataFrame:
    """trial, row, lat and lon of points around a centre, held at the ranges of coordinates."""
    t = trials_of(spark.range(rows).select(F.col("id").alias("row")), trials)
    at = lambda c, s, k, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(c) + s * normal(seed + k, F.col("trial"), F.col("row"))))
    return t.select("trial", "row", at(centre[0], spread[0], 0, 90.0).alias("lat"), at(centre[1], spread[1], 2, 180.0).alias("lon"))


def toroidal_shift(sites: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """trial, lat and lon: all sites moved together by a random shift in both coordinates, which wrap at their ranges."""
    u = lambda k: uniform(seed + k, F.col("trial"), F.lit(0))
    return trials_of(sites.select("lat", "lon"), trials).select("trial", (F.pmod(F.col("lat") + 90.0 + 180.0 * u(0), F.lit(180.0)) - 90.0).alias("lat"), (F.pmod(F.col("lon") + 180.0 + 360.0 * u(1), F.lit(360.0)) - 180.0).alias("lon"))


def smoothed_points(sites: DataFrame, trials: int, rows: int, factors: tuple[float, ...] = (1.0,), seed: int = 42) -> DataFrame:
    """trial, factor, lat and lon drawn from Gaussian kernel densities of the sites (row, lat, lon), their bandwidths Scott's times the factors.

    All factors widen the same draws, so that the sites are met once.
    """
    sd = sites.agg(F.stddev_samp("lat").alias("a"), F.stddev_samp("lon").alias("o")).first()
    wide = max(rows, 1) ** (-1.0 / 6.0)
    slots = trials_of(sites.select("row"), trials).withColumn("i", F.pmod(draw_int(seed, F.col("trial"), F.col("row")), F.lit(rows)))
    drawn = drawn_from(slots, sites.select(F.col("row").alias("i"), "lat", "lon"), "i")
    z = lambda k: normal(seed + k, F.col("trial"), F.col("row"))
    drawn = drawn.select("trial", "lat", "lon", z(2).alias("y"), z(4).alias("x"), F.explode(F.array(*[F.lit(float(f)) for f in factors])).alias("factor"))
    at = lambda c, s, by: F.col(c) + F.col("factor") * wide * (s or 0.0) * F.col(by)
    return drawn.select("trial", "factor", at("lat", sd["a"], "y").alias("lat"), at("lon", sd["o"], "x").alias("lon"))


def block_bootstrap(counts: DataFrame, trials: int, cells: int, seed: int = 42) -> DataFrame:
    """trial, n and near of as many cells (row, n, near) drawn with replacement as there are."""
    slots = trials_of(counts.select(F.col("row").alias("slot")), trials).withColumn("row", F.pmod(draw_int(seed, F.col("trial"), F.col("slot")), F.lit(cells)))
    return slots.join(counts, "row").groupBy("trial").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))
