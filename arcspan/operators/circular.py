"""Directions: means, concentration, tests of uniformity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def circular_summary(df: DataFrame, by: list[str], angle: str, axial: bool = False, toward: float = 0.0, terms: int = 3) -> DataFrame:
    """n, mean_deg, r, std_deg, rayleigh_z, rayleigh_p, v and v_u by group.

    Axial angles are doubled and their mean halved. v is the V-test's statistic toward a direction, v_u = v sqrt(2 n).
    rayleigh_p: exp(-z) with one term, or with the terms of order 1/n and 1/n^2, held in [0, 1]. Nulls are left out.
    """
    a = F.radians(F.col(angle)) * (2.0 if axial else 1.0)
    goal = math.radians(toward) * (2.0 if axial else 1.0)
    s = df.where(F.col(angle).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.cos(a)).alias("__c"), F.avg(F.sin(a)).alias("__s"))
    r = F.sqrt(F.col("__c") ** 2 + F.col("__s") ** 2)
    mean = F.atan2(F.col("__s"), F.col("__c"))
    z = F.col("n") * r * r
    p = rayleigh_p(z, F.col("n"), terms)
    v = r * F.cos(mean - goal)
    return s.select(
        *by, "n", (F.pmod(F.degrees(mean), F.lit(360.0)) / (2.0 if axial else 1.0)).alias("mean_deg"), r.alias("r"),
        (F.degrees(F.sqrt(-2.0 * F.ln(F.greatest(r, F.lit(1e-12))))) / (2.0 if axial else 1.0)).alias("std_deg"), z.alias("rayleigh_z"), p.alias("rayleigh_p"), v.alias("v"), (v * F.sqrt(2.0 * F.col("n"))).alias("v_u"),
    )


def rayleigh_p(z: Column, n: Column, terms: int = 3) -> Column:
    p = F.exp(-z)
    if terms > 1:
        p = p * (1 + (2 * z - z**2) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n * n))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def rose(df: DataFrame, by: list[str], angle: str, width: float) -> DataFrame:
    """bin (its lower edge) and n of directions modulo 360."""
    return df.where(F.col(angle).isNotNull()).groupBy(*by, (F.floor(F.pmod(F.col(angle), F.lit(360.0)) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def uniform_chi2(counts: DataFrame, by: list[str], bins: int) -> DataFrame:
    """chi2 of counted bins (column n) against equal expectation; bins without a row count as 0."""
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("__ss")).select(*by, "n", (F.col("__ss") * float(bins) / F.col("n") - F.col("n")).alias("chi2"))
