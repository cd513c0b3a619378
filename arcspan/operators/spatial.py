"""Points near other points, and points in regions, on a sphere.

Both joins cut the plane of (longitude, latitude) by a quadtree that is grown from a bounded sample, send the point side
to the one leaf that owns it and the box side to every leaf it touches, load an R-tree in each leaf, and refine its hits
exactly. A hit counts only in the leaf that owns its reference point, so that copies of a box yield nothing twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.functions.geo import EARTH_RADIUS_KM

GRID_BITS = 16
SAMPLE_ROWS = 20_000
LEAF_ROWS = 8_192
GROUP_ROWS = 32_768
FAN = 16
FRONTIER = 1_000_000


def _spread_bits(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def z_code(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Place on the Z curve of a 2^16 x 2^16 grid over the world."""
    side = 1 << GRID_BITS
    ix = np.clip(np.floor((lon + 180.0) / 360.0 * side), 0, side - 1)
    iy = np.clip(np.floor((lat + 90.0) / 180.0 * side), 0, side - 1)
    return (_spread_bits(ix) | (_spread_bits(iy) << np.uint64(1))).astype(np.int64)


class QuadTree:
    """Leaves as ranges of the Z curve; grown until a leaf holds at most leaf_rows sampled points or is min_deg wide."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, leaf_rows: int, min_deg: float):
        codes = np.sort(z_code(lon, lat))
        self.starts, self.boxes = [], []
        stack = [(0, 0, 0, 0)]
        while stack:
            depth, ix, iy, start = stack.pop()
            span = 1 << (2 * (GRID_BITS - depth))
            inside = np.searchsorted(codes, start + span) - np.searchsorted(codes, start)
            height = 180.0 / (1 << depth)
            if inside > leaf_rows and depth < GRID_BITS - 2 and height / 2 >= min_deg:
                stack += [(depth + 1, 2 * ix + (k & 1), 2 * iy + (k >> 1), start + k * (span // 4)) for k in range(4)]
            else:
                width = 2 * height
                self.starts.append(start)
                self.boxes.append((-180.0 + ix * width, -90.0 + iy * height, -180.0 + (ix + 1) * width, -90.0 + (iy + 1) * height))
        order = np.argsort(self.starts)
        self.starts = np.asarray(self.starts, dtype=np.int64)[order]
        self.boxes = np.asarray(self.boxes)[order]

    def owner(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, z_code(lon, lat), side="right") - 1

    def touched(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (box, leaf)."""
        return self.met(PackedRTree(self.boxes), boxes)

    @staticmethod
    def met(tree: "PackedRTree", boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (box, leaf), by an R-tree over the leaves."""
        found = list(tree.probe(boxes))
        return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (np.empty(0, int), np.empty(0, int))


class PackedRTree:
    """Sort-tile-recursive bulk load into arrays; probes go down level by level for a whole batch of boxes."""

    def __init__(self, boxes: np.ndarray, fan: int = FAN):
        self.fan, n = fan, len(boxes)
        middle_x, middle_y = boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
        slices = max(1, math.ceil(math.sqrt(math.ceil(n / fan))))
        per_slice = max(1, math.ceil(n / slices))
        slab = np.empty(n, dtype=np.int64)
        slab[np.argsort(middle_x, kind="stable")] = np.arange(n) // per_slice
        self.order = np.lexsort((middle_y, slab))
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > fan:
            below = self.levels[-1]
            cuts = np.arange(0, len(below), fan)
            self.levels.append(
                np.column_stack([np.minimum.reduceat(below[:, 0], cuts), np.minimum.reduceat(below[:, 1], cuts), np.maximum.reduceat(below[:, 2], cuts), np.maximum.reduceat(below[:, 3], cuts)])
            )

    def probe(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (query number, item number) whose boxes meet."""
        if not len(self.order) or not len(queries):
            return
        top = len(self.levels) - 1
        n_top, step = len(self.levels[top]), max(1, FRONTIER // len(self.levels[top]))
        stack = [(top, np.repeat(np.arange(a, min(a + step, len(queries))), n_top), None) for a in range(0, len(queries), step)]
        while stack:
            level, q, node = stack.pop()
            if node is None:
                node = np.tile(np.arange(n_top), len(q) // n_top)
            box = self.levels[level]
            hit = (box[node, 0] <= queries[q, 2]) & (box[node, 2] >= queries[q, 0]) & (box[node, 1] <= queries[q, 3]) & (box[node, 3] >= queries[q, 1])
            q, node = q[hit], node[hit]
            if not len(q):
                continue
            if level == 0:
                yield q, self.order[node]
                continue
            part = max(1, FRONTIER // self.fan)
            for a in range(0, len(q), part):
                first = node[a : a + part] * self.fan
                size = np.minimum(first + self.fan, len(self.levels[level - 1])) - first
                child = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                stack.append((level - 1, np.repeat(q[a : a + part], size), child))


def haversine_np(lat1, lon1, lat2, lon2) -> np.ndarray:
    la1, la2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def reach_boxes(lat: np.ndarray, lon: np.ndarray, km: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes that hold every point within km, one for all or one each, cut at the antimeridian; and of which point each is."""
    angle = np.minimum(np.asarray(km) / EARTH_RADIUS_KM, math.pi) * (1 + 1e-9) + 1e-12
    up = np.degrees(angle)
    sine = np.sin(np.minimum(angle, math.pi / 2)) / np.maximum(np.cos(np.radians(lat)), 1e-300)
    wide = np.where((np.abs(lat) + up >= 90.0) | (sine >= 1.0), 180.0, np.degrees(np.arcsin(np.minimum(sine, 1.0))))
    low, high = lon - wide, lon + wide
    south, north = np.maximum(lat - up, -90.0), np.minimum(lat + up, 90.0)
    whole = wide >= 180.0
    low, high = np.where(whole, -180.0, low), np.where(whole, 180.0, high)
    of = np.arange(len(lat))
    main = np.column_stack([np.maximum(low, -180.0), south, np.minimum(high, 180.0), north])
    west, east = low < -180.0, high > 180.0
    boxes = [main, np.column_stack([low[west] + 360.0, south[west], np.full(west.sum(), 180.0), north[west]]), np.column_stack([np.full(east.sum(), -180.0), south[east], high[east] - 360.0, north[east]])]
    return np.concatenate(boxes), np.concatenate([of, of[west], of[east]])


def usable_points(df: DataFrame, lat: str, lon: str, *keep: F.Column) -> DataFrame:
    """Rows with usable coordinates, as lat and lon in [-180, 180), beside the kept columns.

    Usable: both given (NaN and infinite are missing), latitude within 90 degrees, not both 0.
    """
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    good = la.isNotNull() & lo.isNotNull() & la.between(-90.0, 90.0) & (F.abs(lo) < 1e9) & ~((la == 0) & (lo == 0))
    return df.where(good).select(*keep, la.alias("lat"), (F.pmod(lo + 180.0, F.lit(360.0)) - 180.0).alias("lon"))


def grow_quadtree(points: DataFrame, rows: int, min_deg: float, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, seed: int = 17) -> QuadTree:
    """A quadtree from about sample_rows (at most twice as many) of the points; only where leaves are cut depends on the sample."""
    share = min(1.0, sample_rows / max(rows, 1))
    drawn = points.select("lat", "lon").sample(False, share, seed).limit(2 * sample_rows).toPandas()
    return QuadTree(drawn["lon"].to_numpy(), drawn["lat"].to_numpy(), max(1, round(leaf_rows * share)), min_deg)


def leaf_salts(owned: DataFrame, group_rows: int) -> dict[int, int]:
    """Leaf -> number of shares, by exact counts; as many rows come to the driver as there are leaves over group_rows."""
    return {r["leaf"]: math.ceil(r["n"] / group_rows) for r in owned.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).collect()}


def near_apply(places: DataFrame, sites: DataFrame, km: float, refine: Callable, schema: str, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """What refine(places, sites, hits) makes of the places and sites of each leaf, by the given schema.

    places and sites: rows with lat and lon as usable_points gives them, each a row of its own; hits: batches of (place
    number, site number, km) of all pairs of them at most km apart. A pair is met in one leaf only, once. A leaf with more
    than group_rows of either side is shared out by exact counts, so that no task holds an unbounded group.
    """
    sites = sites.persist(StorageLevel.MEMORY_AND_DISK)
    p_type, s_type = (", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema.fields) for t in (places, sites))
    n_sites = sites.count()
    tree = grow_quadtree(sites, n_sites, 2.5 * math.degrees(km / EARTH_RADIUS_KM), sample_rows, leaf_rows)
    index = PackedRTree(tree.boxes)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=tree.owner(b["lon"].to_numpy(), b["lat"].to_numpy()).astype("int64"))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            boxes, of = reach_boxes(b["lat"].to_numpy(), b["lon"].to_numpy(), km)
            box, leaf = QuadTree.met(index, boxes)
            pairs = np.unique(np.column_stack([of[box], leaf]), axis=0) if len(box) else np.empty((0, 2), int)
            yield b.iloc[pairs[:, 0]].assign(leaf=pairs[:, 1].astype("int64"))

    owned = sites.mapInPandas(own, f"{s_type}, leaf bigint")
    reached = places.mapInPandas(reach, f"{p_type}, leaf bigint").persist(StorageLevel.MEMORY_AND_DISK)
    owned, reached = share_out(owned, reached, leaf_salts(owned, group_rows) if n_sites > group_rows else {}, leaf_salts(reached, group_rows), sites.columns, places.columns)

    def meet(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        s_lat, s_lon, p_lat, p_lon = (x.to_numpy() for x in (s["lat"], s["lon"], p["lat"], p["lon"]))

        def hits() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            if not len(s) or not len(p):
                return
            points = PackedRTree(np.column_stack([s_lon, s_lat, s_lon, s_lat]))
            boxes, of = reach_boxes(p_lat, p_lon, km)
            for q, item in points.probe(boxes):
                at = of[q]
                far = haversine_np(p_lat[at], p_lon[at], s_lat[item], s_lon[item])
                ok = far <= km
                # the reference point of a pair is the site itself, the low corner of box and point; its leaf is this one
                yield at[ok], item[ok], far[ok]

        return refine(p, s, hits())

    return owned.groupBy("leaf", "i", "j").cogroup(reached.groupBy("leaf", "i", "j")).applyInPandas(meet, schema)


def near_join(
    places: DataFrame,
    sites: DataFrame,
    place_key: str,
    site_key: str,
    km: float,
    place_lat: str = "lat",
    place_lon: str = "lon",
    site_lat: str = "lat",
    site_lon: str = "lon",
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Each pair (place key, site key) of which some place row and some site row lie at most km apart, once.

    Rows with unusable coordinates (see usable_points) and sites with a null key match nothing; a null place key is kept.
    Equal rows on either side make no further pairs; empty tables give no rows; other columns of the inputs, whatever
    their names, are left out before the join. Site rows are made distinct first, which takes up hot keys.
    """
    places = usable_points(places, place_lat, place_lon, F.col(place_key).alias("__place")).distinct()
    sites = usable_points(sites.where(F.col(site_key).isNotNull()), site_lat, site_lon, F.col(site_key).alias("__site")).distinct()
    p_type, s_type = places.schema["__place"].dataType.simpleString(), sites.schema["__site"].dataType.simpleString()

    def refine(p: pd.DataFrame, s: pd.DataFrame, hits: Iterator) -> pd.DataFrame:
        code, names = pd.factorize(s["__site"])
        kept = [np.unique(at * np.int64(len(names)) + code[item]) for at, item, _ in hits]
        pairs = np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)
        many = max(len(names), 1)
        return pd.DataFrame({"__place": p["__place"].to_numpy()[pairs // many], "__site": np.asarray(names)[pairs % many]}).astype({"__place": p["__place"].dtype}) if len(pairs) else pd.DataFrame({"__place": p["__place"].iloc[:0], "__site": s["__site"].iloc[:0]})

    pairs = near_apply(places, sites, km, refine, f"__place {p_type}, __site {s_type}", sample_rows, leaf_rows, group_rows)
    return pairs.distinct().select(F.col("__place").alias("place_key"), F.col("__site").alias("site_key"))


def share_out(left: DataFrame, right: DataFrame, left_salts: dict[int, int], right_salts: dict[int, int], left_by: list[str], right_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Columns i and j: each left row in one share i and every j of its leaf, each right row in one j and every i.

    The counts are joined by broadcast: there is at most one a leaf, and leaves are at most about four a sampled point.
    """

    def with_shares(df: DataFrame, salts: dict[int, int], name: str) -> DataFrame:
        if not salts:
            return df.withColumn(name, F.lit(1))
        few = df.sparkSession.createDataFrame(list(salts.items()), f"leaf bigint, {name} int")
        return df.join(F.broadcast(few), "leaf", "left").withColumn(name, F.coalesce(name, F.lit(1)))

    def shared(df: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
        df = with_shares(with_shares(df, left_salts, "n_i"), right_salts, "n_j")
        own_n, other_n = F.col(f"n_{own}"), F.col(f"n_{other}")
        df = df.withColumn(own, F.pmod(F.xxhash64(*by), own_n).cast("int"))
        many = left_salts if other == "i" else right_salts
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), other_n - 1)) if many else F.lit(0))
        return df.drop("n_i", "n_j")

    return shared(left, "i", "j", left_by), shared(right, "j", "i", right_by)


def region_join(
    places: DataFrame,
    vertices: DataFrame,
    place_key: str,
    region_key: str,
    ring: str,
    order: str,
    place_lat: str = "lat",
    place_lon: str = "lon",
    lat: str = "lat",
    lon: str = "lon",
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Each pair (place key, region key) of a place inside a polygon and outside its holes, once.

    Edges are straight in degrees; longitudes of a ring may run past 180 and are compared modulo 360. Inside is by the
    even-odd rule over all rings of a region, its low and left edges included. Rings are told apart by the ring column,
    vertices follow the order column; vertices with a null in any of these columns are left out. Rows with unusable
    coordinates match nothing; equal rows make no further pairs; empty tables give no rows.
    """
    places = usable_points(places, place_lat, place_lon, F.col(place_key).alias("__place")).distinct()
    p_type, r_type = places.schema["__place"].dataType.simpleString(), vertices.schema[region_key].dataType.simpleString()
    n = places.count()
    tree = grow_quadtree(places, n, 0.05, sample_rows, leaf_rows)
    corner = vertices.where(F.col(region_key).isNotNull() & F.col(ring).isNotNull() & F.col(order).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    regions = corner.groupBy(F.col(region_key).alias("__region")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(ring).cast("long").alias("r"), F.col(order).cast("long").alias("v"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")))).alias("v")
    )
    regions = regions.select("__region", F.col("v.r").alias("r"), F.col("v.y").alias("y"), F.col("v.x").alias("x"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=tree.owner(b["lon"].to_numpy(), b["lat"].to_numpy()).astype("int64"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            boxes, of, turn = [], [], []
            for k, (x, y) in enumerate(zip(b["x"], b["y"])):
                for t in range(math.floor((min(x) + 180.0) / 360.0), math.floor((max(x) + 180.0) / 360.0) + 1):
                    boxes.append((min(x) - 360.0 * t, min(y), max(x) - 360.0 * t, max(y)))
                    of.append(k)
                    turn.append(t)
            box, leaf = tree.touched(np.asarray(boxes)) if boxes else (np.empty(0, int), np.empty(0, int))
            of, turn = np.asarray(of, dtype=int), np.asarray(turn, dtype=int)
            yield b.iloc[of[box]].assign(turn=turn[box].astype("int32"), leaf=leaf.astype("int64"))

    owned = places.mapInPandas(own, f"__place {p_type}, lat double, lon double, leaf bigint")
    spread_out = regions.mapInPandas(spread, f"__region {r_type}, r array<bigint>, y array<double>, x array<double>, turn int, leaf bigint")
    owned, spread_out = share_out(owned, spread_out, leaf_salts(owned, group_rows) if n > group_rows else {}, {}, ["__place", "lat", "lon"], ["__region"])

    def refine(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p) and len(r):
            px, py = p["lon"].to_numpy(), p["lat"].to_numpy()
            xs = [np.asarray(x) - 360.0 * t for x, t in zip(r["x"], r["turn"])]
            ys = [np.asarray(y) for y in r["y"]]
            index = PackedRTree(np.array([(x.min(), y.min(), x.max(), y.max()) for x, y in zip(xs, ys)]))
            for q, item in index.probe(np.column_stack([px, py, px, py])):
                for k in np.unique(item):
                    at = q[item == k]
                    inside = even_odd(px[at], py[at], xs[k], ys[k], np.asarray(r["r"].iloc[k]))
                    out.append(pd.DataFrame({"__place": p["__place"].to_numpy()[at[inside]], "__region": r["__region"].iloc[k]}))
        return pd.concat(out) if out else pd.DataFrame({"__place": p["__place"].iloc[:0], "__region": r["__region"].iloc[:0]})

    pairs = owned.groupBy("leaf", "i", "j").cogroup(spread_out.groupBy("leaf", "i", "j")).applyInPandas(refine, f"__place {p_type}, __region {r_type}")
    return pairs.distinct().select(F.col("__place").alias("place_key"), F.col("__region").alias("region_key"))


def even_odd(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether points are inside by the even-odd rule over all rings; one pass over the edges."""
    inside = np.zeros(len(px), dtype=bool)
    for r in np.unique(ring):
        rx, ry = x[ring == r], y[ring == r]
        for x1, y1, x2, y2 in zip(rx, ry, np.roll(rx, -1), np.roll(ry, -1)):
            if y1 != y2:
                crosses = ((y1 <= py) != (y2 <= py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
                inside ^= crosses
    return inside
