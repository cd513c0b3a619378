"""Tail probabilities of tests, for rows that hold one statistic each: lists of tests, never rows of data."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(b, a, 1.0 - x)
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + step * d, 1.0 + step / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out * math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))


def student_two_sided(t: float, freedom: float) -> float:
    return beta_share(freedom / 2.0, 0.5, freedom / (freedom + t * t))


def fisher_tail(f: float, top: float, bottom: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_share(bottom / 2.0, top / 2.0, bottom / (bottom + top * f))


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3:
        return 1.0
    return 0.0 if abs(r) >= 1.0 else student_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def kolmogorov_p(d: float, n1: float, n2: float) -> float:
    """Two-sided asymptotic p of the greatest gap of two empirical distributions."""
    size = d * math.sqrt(n1 * n2 / (n1 + n2))
    return 1.0 if size < 0.2 else min(1.0, max(0.0, 2.0 * math.fsum((-1) ** (k - 1) * math.exp(-2.0 * (k * size) ** 2) for k in range(1, 101))))


def with_p(rows: DataFrame, name: str, p: Callable, *columns: str) -> DataFrame:
    """Adds p(*columns) to each row; null where a column is."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = [None if any(pd.isna(x) for x in row) else p(*map(float, row)) for row in zip(*[b[c] for c in columns])]
            yield b.assign(**{name: pd.Series(values, index=b.index, dtype="float64")})

    return rows.mapInPandas(run, f"{fields}, {name} double")
