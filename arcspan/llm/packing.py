"""Items of varying length put into containers of fixed capacity, as few as can be reached.

The plan is made from the exact histogram of sizes, which has no more classes than the capacity has tokens, whatever the
number of items. It has two levels. Every item is routed to the shortest context window of C, C/2, C/4 ... tokens that
holds it. From the longest tier on, each item of a tier opens a window of its tier, whose gap is filled from the shorter
tiers by subset sums over what is left; a window that cannot be filled is not made, and its item stays single, like what
is left of the shortest tier and a reserve of every size. The windows and the single items are then put together to containers, again by subset sums.
A pattern found so is used as often as its counts allow. Items find their window by their rank within their size, and
windows their container by their rank within their kind, so that no item leaves its executor but for one shuffle of narrow
rows. Containers are numbered by falling cost of attention (the sum of squared lengths) and dealt to step groups to and
fro, which balances the groups.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.operators.ranking import rank_within

TIERS = 5
STEP_CONTAINERS = 16
#: a window is closed only if so much of it is filled; else its item stays single for the second level
FULL = 0.99
#: share of the items of each size that is kept from the windows, so that the second level has small items to fill up with
RESERVE = 0.5
#: gaps up to this many tokens are filled by exact subset sums; of a larger gap the longest items that fit are taken off first
EXACT_GAP = 4096


@dataclass(frozen=True)
class Pattern:
    uses: tuple[tuple[int, int], ...]
    times: int
    fill: int


def fill_gap(gap: int, left: dict[int, int], sizes: list[int]) -> list[tuple[int, int]]:
    """(size, number) from what is left that fills as much of the gap as can be, of equal fills that with the longest items.

    sizes: falling. Sizes that can be reached are kept as the bits of an integer, one integer per size, longest first.
    """
    taken: dict[int, int] = {}
    k = bisect.bisect_left(sizes, -gap, key=lambda s: -s)
    while gap > EXACT_GAP and k < len(sizes):
        s = sizes[k]
        n = min(left[s], (gap - EXACT_GAP // 2) // s) if s <= gap else 0
        if n > 0:
            taken[s] = n
            gap -= n * s
        k += 1
    mask = (1 << (gap + 1)) - 1
    reach, steps, usable = 1, [], []
    for s in sizes[bisect.bisect_left(sizes, -gap, key=lambda s: -s) :]:
        most = min(left[s] - taken.get(s, 0), gap // s)
        if most <= 0:
            continue
        usable.append(s)
        steps.append(reach)
        n, k = most, 1
        while n > 0:
            k = min(k, n)
            reach |= (reach << (s * k)) & mask
            n -= k
            k *= 2
        if reach >> gap & 1:
            break
    target = reach.bit_length() - 1
    for s, before in zip(reversed(usable), reversed(steps)):
        while not before >> target & 1:
            target -= s
            taken[s] = taken.get(s, 0) + 1
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int, opening: tuple[int, int] | None = None, full: float = 0.0) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns, and what is left. histogram: size (1 to capacity) -> items.

    opening: only sizes in this half-open range open a pattern. full: patterns that fill less than this share are not made.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left, reverse=True)
    low, high = opening or (0, capacity)
    patterns = []
    for s in [s for s in sizes if low < s <= high]:
        while left[s] > 0:
            left[s] -= 1
            uses = {s: 1}
            for size, n in fill_gap(capacity - s, left, sizes):
                uses[size] = uses.get(size, 0) + n
            left[s] += 1
            if sum(size * n for size, n in uses.items()) < full * capacity:
                break
            times = min(left[size] // n for size, n in uses.items())
            for size, n in uses.items():
                left[size] -= n * times
            patterns.append(Pattern(tuple(sorted(uses.items(), reverse=True)), times, sum(size * n for size, n in uses.items())))
    return patterns, {s: n for s, n in left.items() if n > 0}


def widths(capacity: int, tiers: int) -> list[int]:
    """Context windows of the tiers, longest first."""
    return [w for w in (capacity >> t for t in range(tiers)) if w > 0]


class Plan:
    """Both levels of a plan, as sorted arrays in which (size, rank) finds its container. A bounded object: see the module."""

    def __init__(self, histogram: dict[int, int], capacity: int, tiers: int = TIERS):
        self.widths = widths(capacity, tiers)
        windows: list[tuple[int, Pattern]] = []
        reserve = {s: math.ceil(n * RESERVE) for s, n in histogram.items()} if len(self.widths) > 1 else {}
        left = {s: n - reserve.get(s, 0) for s, n in histogram.items()}
        for t, (width, below) in enumerate(zip(self.widths, self.widths[1:])):
            found, left = plan(left, width, (below, width), FULL)
            windows += [(t, p) for p in found]
        left = {s: left.get(s, 0) + reserve.get(s, 0) for s in histogram}
        # the shortest tier and what opened no window stay single: windows of one item
        windows += [(len(self.widths) - 1, Pattern(((s, 1),), n, s)) for s, n in sorted(left.items(), reverse=True) if n > 0]
        kinds: dict[int, int] = {}
        self.item_slots: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        squares: dict[int, float] = {}
        for _, p in windows:
            for size, n in p.uses:
                self.item_slots.setdefault(size, []).append((used.get(size, 0), kinds.get(p.fill, 0), n, p.fill))
                used[size] = used.get(size, 0) + n * p.times
            squares[p.fill] = squares.get(p.fill, 0.0) + p.times * sum(n * size * size for size, n in p.uses)
            kinds[p.fill] = kinds.get(p.fill, 0) + p.times
        self.windows = sum(p.times for _, p in windows)
        cost = {fill: squares[fill] / kinds[fill] for fill in kinds}
        containers, _ = plan(kinds, capacity)
        self.containers = sorted(containers, key=lambda p: (-sum(n * cost[f] for f, n in p.uses), -p.fill, p.uses))
        self.total = sum(p.times for p in self.containers)
        self.kind_slots: dict[int, list[tuple[int, int, int]]] = {}
        used, at = {}, 0
        for p in self.containers:
            for fill, n in p.uses:
                self.kind_slots.setdefault(fill, []).append((used.get(fill, 0), at, n))
                used[fill] = used.get(fill, 0) + n * p.times
            at += p.times
        self.item_slots = {k: np.array(v, dtype=np.int64).T for k, v in self.item_slots.items()}
        self.kind_slots = {k: np.array(v, dtype=np.int64).T for k, v in self.kind_slots.items()}

    def place(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The container of each item, by its size and its rank within the size."""
        kind, at = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
        for s in np.unique(size):
            first, start, n, fill = self.item_slots[int(s)]
            here = np.flatnonzero(size == s)
            k = np.searchsorted(first, rank[here], side="right") - 1
            kind[here], at[here] = fill[k], start[k] + (rank[here] - first[k]) // n[k]
        out = np.empty(len(size), dtype=np.int64)
        for f in np.unique(kind):
            first, start, n = self.kind_slots[int(f)]
            here = np.flatnonzero(kind == f)
            k = np.searchsorted(first, at[here], side="right") - 1
            out[here] = start[k] + (at[here] - first[k]) // n[k]
        return out


def pack(sized: DataFrame, item: str, size: str, capacity: int, step_containers: int = STEP_CONTAINERS, tiers: int = TIERS) -> DataFrame:
    """item, piece (from 0), pieces, tokens, tier (from 0, the longest), container_id (from 0) and step_id, one row a piece.

    An item longer than the capacity is cut into full pieces and a rest; any other stays whole. Items without length (null
    or at most 0) take no room and come out with a null tier, container and step. A null id is kept; repeated ids are items
    of their own; ties in size are broken by a hash of the id; an empty table gives no rows; other columns are not read.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    whole = sized.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    pieces = F.greatest(F.ceil(F.col("n") / F.lit(capacity)).cast("int"), F.lit(1))
    rows = whole.select("item", "n", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    rows = rows.select("item", "piece", "pieces", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).alias("tokens"))
    tier = sum([(F.col("tokens") <= w).cast("int") for w in widths(capacity, tiers)[1:]], F.lit(0))
    rows = rows.withColumn("tier", F.when(F.col("tokens") > 0, tier)).persist(StorageLevel.MEMORY_AND_DISK)
    histogram = {r["tokens"]: r["n"] for r in rows.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # as many as the capacity at most
    made = Plan(histogram, capacity, tiers)
    groups = max(1, math.ceil(made.total / step_containers))
    shared = sized.sparkSession.sparkContext.broadcast(made)
    ranked = rank_within(rows.where("tokens > 0"), ["tokens"], [], ["item", "piece"])
    kind = sized.schema[item].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["item", "piece", "pieces", "tokens", "tier"]].assign(container_id=shared.value.place(b["tokens"].to_numpy(), b["rank"].to_numpy()))

    placed = ranked.mapInPandas(place, f"item {kind}, piece int, pieces int, tokens bigint, tier int, container_id bigint")
    lap, at = F.floor(F.col("container_id") / groups), F.pmod("container_id", F.lit(groups))
    placed = placed.withColumn("step_id", F.when(F.pmod(lap, F.lit(2)) == 0, at).otherwise(groups - 1 - at).cast("long"))
    nothing = rows.where("tokens <= 0").select("item", "piece", "pieces", "tokens", "tier", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("step_id"))
    return placed.unionByName(nothing).withColumnRenamed("item", item)
