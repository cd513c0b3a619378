"""Distance, nearest, as-of, interval and lagged joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcspan.functions.geo import EARTH_RADIUS_KM, haversine_km
from arcspan.operators.poles import unit_vectors
from arcspan.operators.spatial import GROUP_ROWS, LEAF_ROWS, SAMPLE_ROWS, PackedRTree, QuadTree, grow_quadtree, haversine_np, leaf_salts, near_apply, near_join, reach_boxes, share_out, usable_points, z_code

#: neighbours on the Z curve, before and after, from which nearest() takes its first bound
PILOTS = 8


def _cells(lat: float, lon: float, km: float, cell: float) -> list[int]:
    """Cells that a circle touches, in rows of latitude each cut into about as wide cells."""
    up = math.degrees(km / EARTH_RADIUS_KM) * (1 + 1e-9) + 1e-9 * (km > 0)
    low, high = max(lat - up, -90.0), min(lat + up, 90.0)
    out = []
    for band in range(math.floor((low + 90.0) / cell), math.floor((high + 90.0) / cell) + 1):
        edge = min(90.0, max(abs(band * cell - 90.0), abs((band + 1) * cell - 90.0)))
        count = max(1, math.floor(360.0 * math.cos(math.radians(edge)) / cell))
        sine = math.sin(math.radians(min(up, 90.0))) / max(math.cos(math.radians(lat)), 1e-12)
        wide = 180.0 if km > 0 and (abs(lat) + up >= 90.0 or sine >= 1) else math.degrees(math.asin(min(sine, 1.0))) + 1e-9 * (km > 0)
        first, last = math.floor((lon + 180.0 - wide) / 360.0 * count), math.floor((lon + 180.0 + wide) / 360.0 * count)
        out += [band * 100_000_000 + k % count for k in (range(count) if last - first + 1 >= count else range(first, last + 1))]
    return out


def with_cells(df: DataFrame, km: float, cell: float, name: str = "cell") -> DataFrame:
    """A row for each cell, of so many degrees, that a circle of km around the row's lat and lon touches."""
    schema = df.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_cells(a, o, km, cell) for a, o in zip(b["lat"], b["lon"])]
            out = b.loc[b.index.repeat([len(f) for f in found])].copy()
            out[name] = np.array([c for f in found for c in f], dtype="int64")
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.mapInPandas(run, f"{fields}, {name} bigint")


def distance_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float) -> DataFrame:
    """a, b and km of all pairs of a left and a right row (with lat and lon) at most km apart; see near_join for edge cases."""
    key = lambda i: F.concat_ws("\u0001", F.col(i).cast("string"), F.col("lat").cast("string"), F.col("lon").cast("string")).alias("k")
    pairs = near_join(left.select(key(left_id), "lat", "lon"), right.select(key(right_id), "lat", "lon"), "k", "k", km)
    part = lambda c, n: F.split(F.col(c), "\u0001")[n]
    return pairs.select(
        part("place_key", 0).cast(left.schema[left_id].dataType).alias("a"), part("site_key", 0).cast(right.schema[right_id].dataType).alias("b"),
        haversine_km(part("place_key", 1).cast("double"), part("place_key", 2).cast("double"), part("site_key", 1).cast("double"), part("site_key", 2).cast("double")).alias("km"),
    )


def near_counts(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radii: list[float], same: bool = True) -> DataFrame:
    """left_id and n0, n1 ...: right rows (distinct ids and coordinates) within each of the radii of each left row that has any.

    Counted where the pairs are found, one row a left row and leaf, so that no pair is shuffled. same: whether a right row
    of the same id counts. Rows with unusable coordinates and null right ids are left out; a null left id is kept.
    """
    l = usable_points(left, "lat", "lon", F.col(left_id).alias("a")).distinct()
    r = usable_points(right.where(F.col(right_id).isNotNull()), "lat", "lon", F.col(right_id).alias("b")).distinct()
    a_type, names = l.schema["a"].dataType.simpleString(), [f"n{k}" for k in range(len(radii))]

    def refine(p: pd.DataFrame, s: pd.DataFrame, hits: Iterator) -> pd.DataFrame:
        n = np.zeros((len(radii), len(p)), dtype=np.int64)
        pa, sb = p["a"].to_numpy(), s["b"].to_numpy()
        for at, item, km in hits:
            if not same:
                other = pa[at] != sb[item]
                at, km = at[other], km[other]
            for k, radius in enumerate(radii):
                n[k] += np.bincount(at[km <= radius], minlength=len(p))
        some = n.any(axis=0)
        return pd.DataFrame({"a": p["a"][some]} | {c: n[k][some] for k, c in enumerate(names)})

    parts = near_apply(l, r, max(radii), refine, f"a {a_type}, " + ", ".join(f"{c} bigint" for c in names))
    return parts.groupBy(F.col("a").alias(left_id)).agg(*[F.sum(c).alias(c) for c in names])


def pair_bands(points: DataFrame, key: str, edges: list[float], classes: str | None = None) -> DataFrame:
    """band (from 0), pairs and same: unordered pairs of different ids whose distance lies in each half-open band of edges (the last one closed), and how many agree in a column.

    Counted where the pairs are found; points of one id make no pair. Null classes agree with nothing.
    """
    cls = F.col(classes).cast("string") if classes else F.lit(None).cast("string")
    rows = usable_points(points.where(F.col(key).isNotNull()), "lat", "lon", F.col(key).alias("a"), cls.alias("c")).distinct()

    def refine(p: pd.DataFrame, s: pd.DataFrame, hits: Iterator) -> pd.DataFrame:
        n, same = np.zeros(len(edges) - 1, dtype=np.int64), np.zeros(len(edges) - 1, dtype=np.int64)
        pa, sa, pc, sc = p["a"].to_numpy(), s["a"].to_numpy(), p["c"].to_numpy(), s["c"].to_numpy()
        for at, item, km in hits:
            band = np.minimum(np.searchsorted(edges, km, side="right") - 1, len(edges) - 2)
            ok = (pa[at] < sa[item]) & (band >= 0)
            n += np.bincount(band[ok], minlength=len(n))
            if classes:
                x, y = pc[at[ok]], sc[item[ok]]
                same += np.bincount(band[ok][(x == y) & (x != None)], minlength=len(n))  # noqa: E711
        return pd.DataFrame({"band": np.arange(len(n)), "pairs": n, "same": same})[n > 0]

    return near_apply(rows, rows, edges[-1], refine, "band bigint, pairs bigint, same bigint").groupBy("band").agg(F.sum("pairs").alias("pairs"), F.sum("same").alias("same"))


def with_near(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float, strict: bool = False) -> DataFrame:
    """left_id and near: the smallest right id at most (strict: less than) km away, of the left rows that have one.

    A left row leaves a leaf at most once, however many right rows are near.
    """
    l = usable_points(left, "lat", "lon", F.col(left_id).alias("a")).distinct()
    r = usable_points(right.where(F.col(right_id).isNotNull()), "lat", "lon", F.col(right_id).alias("b")).distinct()
    a_type, b_type = l.schema["a"].dataType.simpleString(), r.schema["b"].dataType.simpleString()

    def refine(p: pd.DataFrame, s: pd.DataFrame, hits: Iterator) -> pd.DataFrame:
        rank = s["b"].rank(method="first").to_numpy().astype(np.int64) if len(s) else np.empty(0, np.int64)
        first = np.full(len(p), len(s) + 1, dtype=np.int64)
        for at, item, far in hits:
            ok = far < km if strict else far <= km
            np.minimum.at(first, at[ok], rank[item[ok]])
        some = first <= len(s)
        by_rank = s["b"].to_numpy()[np.argsort(rank)] if len(s) else s["b"].to_numpy()
        return pd.DataFrame({"a": p["a"][some], "b": by_rank[first[some] - 1]}) if some.any() else pd.DataFrame({"a": p["a"].iloc[:0], "b": s["b"].iloc[:0]})

    return near_apply(l, r, km, refine, f"a {a_type}, b {b_type}").groupBy(F.col("a").alias(left_id)).agg(F.min("b").alias("near"))


def without_near(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float, strict: bool = False) -> DataFrame:
    """Left rows that have no right row at most (strict: less than) km away."""
    return left.join(with_near(left, right, left_id, right_id, km, strict).select(left_id), left_id, "left_anti")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """left_id, nearest (a right id, of ties the smallest) and km for each left row with usable coordinates, exactly.

    Two passes over the leaves of a quadtree that follows the density of the right side. First each left row meets one share
    of its own leaf, or of the closest leaf that has right rows, and takes from its neighbours on the Z curve a distance
    beyond which nothing can be nearest. Then it goes to those leaves only that this distance touches, whose R-trees are
    probed by it, and keeps one candidate a leaf. Full leaves are shared out by exact counts.

    Null right ids and rows with unusable coordinates are left out; equal rows come out once; without right rows nothing
    comes out; other columns are not read.
    """
    l = usable_points(left, "lat", "lon", F.col(left_id).alias("a")).distinct()
    r = usable_points(right.where(F.col(right_id).isNotNull()), "lat", "lon", F.col(right_id).alias("b")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    a_type, b_type = l.schema["a"].dataType.simpleString(), r.schema["b"].dataType.simpleString()
    n = r.count()
    if not n:
        return l.select(F.col("a").alias(left_id)).limit(0).withColumns({"nearest": F.lit(None).cast(b_type), "km": F.lit(None).cast("double")})
    tree = grow_quadtree(r, n, 0.02, sample_rows, leaf_rows)
    index = PackedRTree(tree.boxes)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=tree.owner(b["lon"].to_numpy(), b["lat"].to_numpy()).astype("int64"))

    owned = r.mapInPandas(own, f"b {b_type}, lat double, lon double, leaf bigint")
    held = {x["leaf"]: x["n"] for x in owned.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most the leaves of the sample's tree
    full = np.array(sorted(held), dtype=np.int64)
    middle = unit_vectors((tree.boxes[:, 1] + tree.boxes[:, 3]) / 2, (tree.boxes[:, 0] + tree.boxes[:, 2]) / 2)
    salts = {k: math.ceil(v / group_rows) for k, v in held.items() if v > group_rows}

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, int] = {}
        for b in batches:
            home = tree.owner(b["lon"].to_numpy(), b["lat"].to_numpy())
            for h in np.unique(home):
                if h not in known:
                    known[h] = int(h) if int(h) in held else int(full[np.argmax(middle[full] @ middle[h])])
            yield b.assign(leaf=np.array([known[h] for h in home], dtype="int64"))

    first = l.mapInPandas(start, f"a {a_type}, lat double, lon double, leaf bigint").persist(StorageLevel.MEMORY_AND_DISK)
    pilots, asked = share_out(owned, first, salts, leaf_salts(first, group_rows), ["b", "lat", "lon"], ["a", "lat", "lon"])

    def bound(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if s.empty or p.empty:
            return pd.DataFrame({"a": p["a"].iloc[:0], "lat": p["lat"].iloc[:0], "lon": p["lon"].iloc[:0], "most": pd.Series(dtype=float)})
        s_lat, s_lon, p_lat, p_lon = (x.to_numpy() for x in (s["lat"], s["lon"], p["lat"], p["lon"]))
        code = z_code(s_lon, s_lat)
        order = np.argsort(code, kind="stable")
        at = np.searchsorted(code[order], z_code(p_lon, p_lat))
        most = np.full(len(p), np.inf)
        tries = [np.clip(at + k, 0, len(s) - 1) for k in range(-PILOTS, PILOTS)] + [np.full(len(p), k) for k in np.linspace(0, len(s) - 1, 4 * PILOTS).astype(int)]
        for pick in tries:
            item = order[pick]
            most = np.minimum(most, haversine_np(p_lat, p_lon, s_lat[item], s_lon[item]))
        return pd.DataFrame({"a": p["a"].to_numpy(), "lat": p_lat, "lon": p_lon, "most": most}).astype({"a": p["a"].dtype})

    # one share of a full leaf is enough for a bound
    bounds = pilots.where("i = 0").groupBy("leaf", "j").cogroup(asked.where("i = 0").groupBy("leaf", "j")).applyInPandas(bound, f"a {a_type}, lat double, lon double, most double")

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            boxes, of = reach_boxes(b["lat"].to_numpy(), b["lon"].to_numpy(), b["most"].to_numpy())
            box, leaf = QuadTree.met(index, boxes)
            pairs = np.unique(np.column_stack([of[box], leaf]), axis=0) if len(box) else np.empty((0, 2), int)
            pairs = pairs[np.isin(pairs[:, 1], full)]
            yield b.iloc[pairs[:, 0]].assign(leaf=pairs[:, 1].astype("int64"))

    reached = bounds.mapInPandas(reach, f"a {a_type}, lat double, lon double, most double, leaf bigint").persist(StorageLevel.MEMORY_AND_DISK)
    shared, wanted = share_out(owned, reached, salts, leaf_salts(reached, group_rows), ["b", "lat", "lon"], ["a", "lat", "lon"])

    def best(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if s.empty or p.empty:
            return pd.DataFrame({"a": p["a"].iloc[:0], "b": s["b"].iloc[:0], "km": pd.Series(dtype=float)})
        s = s.sort_values("b", kind="stable")
        s_lat, s_lon, p_lat, p_lon, most = (x.to_numpy() for x in (s["lat"], s["lon"], p["lat"], p["lon"], p["most"]))
        near, pick = np.full(len(p), np.inf), np.full(len(p), -1, dtype=np.int64)
        boxes, of = reach_boxes(p_lat, p_lon, most)
        for q, item in PackedRTree(np.column_stack([s_lon, s_lat, s_lon, s_lat])).probe(boxes):
            at = of[q]
            far = haversine_np(p_lat[at], p_lon[at], s_lat[item], s_lon[item])
            by = np.lexsort((item, far, at))
            top = by[np.unique(at[by], return_index=True)[1]]
            at, item, far = at[top], item[top], far[top]
            closer = (far < near[at]) | (far == near[at]) & (item < pick[at])
            near[at[closer]], pick[at[closer]] = far[closer], item[closer]
        some = pick >= 0
        return pd.DataFrame({"a": p["a"].to_numpy()[some], "b": s["b"].to_numpy()[pick[some]], "km": near[some]})

    found = shared.groupBy("leaf", "i", "j").cogroup(wanted.groupBy("leaf", "i", "j")).applyInPandas(best, f"a {a_type}, b {b_type}, km double")
    return found.groupBy("a").agg(F.min(F.struct("km", "b")).alias("x")).select(F.col("a").alias(left_id), F.col("x.b").alias("nearest"), F.col("x.km").alias("km"))


def prefix_matches(left: DataFrame, bases: DataFrame, text: str, base: str) -> DataFrame:
    """Left rows beside each base that their text begins with, whatever the number of bases and their lengths.

    Texts are cut to the lengths that bases have, which come from a join on the first letter, so that no list is collected.
    Empty and null bases match nothing; bases are made distinct.
    """
    b = bases.where(F.coalesce(F.length(base) > 0, F.lit(False))).select(F.col(base).alias(base)).distinct()
    sizes = b.select(F.substring(base, 1, 1).alias("__first"), F.length(base).alias("__size")).groupBy("__first").agg(F.collect_set("__size").alias("__sizes"))
    keyed = left.withColumn("__first", F.substring(text, 1, 1)).join(sizes, "__first").withColumn("__size", F.explode("__sizes")).where(F.col("__size") <= F.length(text))
    return keyed.withColumn(base, F.expr(f"substring(`{text}`, 1, __size)")).join(b, base).drop("__first", "__size", "__sizes")


def asof_tolerance(left: DataFrame, right: DataFrame, left_id: str, left_at: str, right_at: str, value: str, tolerance: float) -> DataFrame:
    """Each left row with the right row whose time is nearest, at most tolerance away; of equal gaps the earlier, then smaller value.

    Right rows are put into bins as wide as the tolerance, left rows look into their own and the two beside it.
    """
    l = left.select(F.col(left_id).alias("id"), F.col(left_at).cast("double").alias("t")).withColumn("bin", F.explode(F.array(*[F.floor(F.col("t") / tolerance) + k for k in (-1, 0, 1)])))
    r = right.select(F.col(right_at).cast("double").alias("rt"), F.col(value).alias("v")).where(F.col("rt").isNotNull()).withColumn("bin", F.floor(F.col("rt") / tolerance))
    gap = F.abs(F.col("t") - F.col("rt"))
    return l.join(r, "bin").where(gap <= tolerance).groupBy("id", "t").agg(F.min(F.struct(gap.alias("gap"), F.col("rt"), F.col("v"))).alias("x")).select(F.col("id").alias(left_id), F.col("t").alias(left_at), F.col("x.rt").alias("matched"), F.col("x.v").alias(value), F.col("x.gap").alias("gap"))


def overlapping_bins(spans: DataFrame, low: str, high: str, start: int, stop: int, width: int) -> DataFrame:
    """A row for each bin [t, t + width] that a closed span [low, high] touches, of the bins that start at start, start + width ..."""
    first = F.greatest(F.ceil((F.col(low) - start - width) / F.lit(width)), F.lit(0))
    last = F.least(F.floor((F.col(high) - start) / F.lit(width)), F.lit((stop - start) // width - 1))
    return spans.where((last >= first) & (F.col(low) <= F.col(high))).withColumn("bin", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("bin", F.col("bin") * width + start)


def lagged(left: DataFrame, right: DataFrame, at: str, left_value: str, right_value: str, lags: list[int]) -> DataFrame:
    """lag, at, x and y: the left value at t beside the right value at t - lag, for each lag."""
    shifted = left.select(F.col(at).alias("t"), F.col(left_value).alias("x")).withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("u", F.col("t") - F.col("lag"))
    return shifted.join(right.select(F.col(at).alias("u"), F.col(right_value).alias("y")), "u").select("lag", F.col("t").alias(at), "x", "y")


def consecutive(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row beside the next one of its group, as next_ columns; the last of a group is left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"__more": F.lead(F.lit(1)).over(w)})
    return out.where("__more = 1").drop("__more")
