"""Deduplication of places: by rounded key, by site key, by an ordered fold, and greedily by radius."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspan.functions.geo import haversine_km
from arcspan.operators.joins import with_cells, without_near
from arcspan.operators.spatial import usable_points
from arcspan.plans.runtime import cut_lineage


def first_by_key(df: DataFrame, keys: dict[str, Column], order: list[str]) -> DataFrame:
    """The first row by the order columns of each key; keys: name -> expression. Nulls in a key make a group like any value."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*[e.alias(k) for k, e in keys.items()]).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def rounded_first(df: DataFrame, digits: int, order: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """First row of each pair of rounded coordinates; halves go to the even digit."""
    return first_by_key(df, {"lat_key": F.bround(lat, digits), "lon_key": F.bround(lon, digits)}, order)


def by_site(df: DataFrame, site: str, lat: str, lon: str, age: str, digits: int = 2) -> DataFrame:
    """One row per site id, or per rounded coordinates where the id is blank: mean coordinates, oldest age, number of rows."""
    named = F.coalesce(F.trim(F.col(site)) != "", F.lit(False))
    key = F.when(named, F.concat(F.lit("id:"), F.trim(F.col(site)))).otherwise(F.concat(F.lit("at:"), F.bround(lat, digits).cast("string"), F.lit(","), F.bround(lon, digits).cast("string")))
    return df.groupBy(key.alias("site_key")).agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.max(age).alias("oldest"), F.count("*").alias("dates"))


def ordered_fold(df: DataFrame, lat: str, lon: str, age: str, degrees: float = 0.01, years: float = 200.0, closed: bool = False) -> DataFrame:
    """Rows in order of rounded coordinates and age, less those that lie within all tolerances (closed: or on one) of the last kept row.

    The fold depends on what was kept before, so it runs in Arrow groups: stretches of the order between gaps of more than
    twice a tolerance, over which no kept row can reach. Of rows equal in coordinates and age one is kept beforehand (the
    least of its other columns), so a stretch holds distinct ages of close places. Rows with a null in one of the three
    columns are left out; an empty frame stays empty.
    """
    rest = [c for c in df.columns if c not in (lat, lon, age)]
    known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(age).isNotNull())
    one = known.groupBy(lat, lon, age).agg(*([F.min(F.struct(*rest)).alias("__rest")] if rest else [F.first(F.lit(0)).alias("__rest")]))
    one = one.select(lat, lon, age, *([F.col(f"__rest.{c}").alias(c) for c in rest]))
    keyed = one.withColumns({"__la": F.bround(lat, 2), "__lo": F.bround(lon, 2)})
    reach, span = 2 * degrees + 0.0101, 2 * years
    order = ["__lo", age, lat, lon]
    w = Window.partitionBy("__la").orderBy(*order)
    gap = (F.col("__lo") - F.lag("__lo").over(w) > reach) | (F.abs(F.col(age) - F.lag(age).over(w)) > span)
    parts = keyed.withColumn("__new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("__i", F.sum("__new").over(w))
    # one row a rounded latitude, 18 001 at most: whether its first stretch goes on from the latitude before
    bands = parts.groupBy("__la").agg(F.min_by(F.struct("__lo", age), F.struct(*order)).alias("head"), F.max_by(F.struct("__lo", age), F.struct(*order)).alias("tail"), F.max("__i").alias("last"))
    b = Window.orderBy("__la")
    before = lambda c: F.lag(c).over(b)
    linked = F.coalesce((F.col("__la") - before("__la") <= reach) & (F.abs(F.col("head.__lo") - before("tail.__lo")) <= reach) & (F.abs(F.col(f"head.{age}") - before(f"tail.{age}")) <= span), F.lit(False))
    anchor = F.when(~linked, F.struct(F.col("__la").alias("la"), F.lit(0).cast("long").alias("i"))).when(before("last") > 0, F.struct(before("__la").alias("la"), before("last").cast("long").alias("i")))
    roots = bands.withColumn("__anchor", anchor).select(F.col("__la").alias("__band"), F.last("__anchor", True).over(b.rowsBetween(Window.unboundedPreceding, 0)).alias("__root"))
    joined = parts.join(F.broadcast(roots), F.col("__la") == F.col("__band"))
    stretch = F.when(F.col("__i") == 0, F.col("__root")).otherwise(F.struct(F.col("__la").alias("la"), F.col("__i").cast("long").alias("i")))
    joined = joined.withColumns({"__ga": stretch["la"], "__gi": stretch["i"]}).select(*df.columns, "__la", "__lo", "__ga", "__gi")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["__la", "__lo", age, lat, lon], kind="stable")
        keep, last = np.zeros(len(g), dtype=bool), None
        for k, (a, o, t) in enumerate(zip(g[lat].to_numpy(), g[lon].to_numpy(), g[age].to_numpy())):
            gaps = () if last is None else ((abs(a - last[0]), degrees), (abs(o - last[1]), degrees), (abs(t - last[2]), years))
            if last is None or not all(g <= most if closed else g < most for g, most in gaps):
                keep[k], last = True, (a, o, t)
        return g[keep]

    return joined.groupBy("__ga", "__gi").applyInPandas(fold, joined.schema).select(*df.columns)


def greedy_radius(df: DataFrame, key: str, priority: str, km: float) -> DataFrame:
    """Rows kept when, in order of priority then key, a row is dropped if a kept one lies within km.

    Rounds over cells, not over pairs: the best undecided row of a cell is kept if it is better than the best undecided
    rows of all cells within its reach; then what lies within km of a newly kept row is dropped, of which there are few in
    reach of any row, as kept rows lie more than km apart. The overall best row is decided in each round, so the loop ends.
    Lineage is cut by reliable checkpoints. Rows without usable coordinates are kept; keys must be unique and not null.
    """
    cell = max(0.02, km / 111.195)
    todo = cut_lineage(usable_points(df, "lat", "lon", F.col(key).alias("k"), F.struct(F.col(priority).alias("p"), F.col(key).alias("k")).alias("r")).select("k", F.col("r.p").alias("p"), "lat", "lon"))
    rank = lambda: F.struct("p", "k")
    dropped = None
    while True:
        owned = with_cells(todo, 0.0, cell)
        best = cut_lineage(owned.groupBy("cell").agg(F.min_by(F.struct("k", "p", "lat", "lon"), rank()).alias("x")).select("cell", "x.*"))
        if best.isEmpty():
            break
        seen = with_cells(best.select("k", "p", "lat", "lon"), km, cell).join(best.select("cell", F.struct(F.col("p"), F.col("k")).alias("b")), "cell")
        kept = cut_lineage(seen.groupBy("k", "p", "lat", "lon").agg(F.min("b").alias("b")).where(F.struct("p", "k") == F.col("b")).select("k", "p", "lat", "lon"))
        near = with_cells(kept.select("k", "p", "lat", "lon"), km, cell).select("cell", F.col("k").alias("kk"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
        gone = owned.join(near, "cell").where((F.col("k") != F.col("kk")) & (haversine_km("lat", "lon", "la", "lo") <= km)).select("k").distinct()
        gone = cut_lineage(gone)
        dropped = gone if dropped is None else cut_lineage(dropped.unionByName(gone))
        todo = cut_lineage(todo.join(gone, "k", "left_anti").join(kept.select("k"), "k", "left_anti"))
    return df if dropped is None else df.join(dropped.select(F.col("k").alias(key)), key, "left_anti")


def without_other_source(df: DataFrame, key: str, priority: str, source: str, km: float, strict: bool = True) -> DataFrame:
    """Rows of the sources in order of priority, each less the rows nearer than km (not strict: or as near) to a kept row of a better source.

    One pass a source: rows of one source never drop each other. The number of sources is a stated list's.
    """
    order = [r[0] for r in df.groupBy(source).agg(F.min(priority).alias("p")).orderBy("p", source).limit(1_001).collect()]
    if len(order) > 1_000:
        raise ValueError("more than 1 000 sources")
    kept = None
    for name in order:
        part = df.where(F.col(source).eqNullSafe(name))
        if kept is not None:
            part = without_near(part, kept, key, key, km, strict)
        part = cut_lineage(part)
        kept = part if kept is None else kept.unionByName(part)
    return df if kept is None else kept
