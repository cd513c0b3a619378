"""Streaming forms of the time operators: corridor counts by window, sessions by gap, running state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.functions.geo import circle_km


def windowed_counts(stream: DataFrame, at: str, window: str, late: str, thresholds: list[float], slide: str | None = None) -> DataFrame:
    """Points by event-time window within each distance of the default circle; rows later than the watermark are dropped."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    d = stream.withWatermark(at, late).withColumn("km", circle_km("lat", "lon"))
    return d.groupBy(w.alias("w")).agg(F.count("*").alias("n"), *[F.count_if(F.col("km") <= t).alias(f"within_{t:g}") for t in thresholds]).select("w.start", "w.end", "n", *[f"within_{t:g}" for t in thresholds])


def gap_sessions(stream: DataFrame, by: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Rows and span of each session of a key; a session ends when nothing comes for the gap."""
    return stream.withWatermark(at, late).groupBy(*by, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n")).select(*by, "s.start", "s.end", "n")


def nearest_so_far(stream: DataFrame, key: str) -> DataFrame:
    """Each time a key comes nearer to the circle than before: the key, the distance and the number of its rows so far."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, n = state.get if state.exists else (float("inf"), 0)
        found = best
        for b in batches:
            n += len(b)
            low = b["km"].min()
            found = min(found, low) if pd.notna(low) else found
        state.update((float(found), int(n)))
        if found < best:
            yield pd.DataFrame({key: [k[0]], "km": [found], "rows": [n]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.withColumn("km", circle_km("lat", "lon")).select(key, "km").groupBy(key).applyInPandasWithState(update, f"{key} {kind}, km double, rows bigint", "best double, n bigint", "append", "NoTimeout")
