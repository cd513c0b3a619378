"""Rows of two tables that describe the same place, without a common key, each pair with a confidence.

All records within reach of each other are compared, found by cells of the sphere, as any key cut from a name loses pairs
that a slip or a swap spoils; records alike in every attribute are compared once. Similarity vectors (name less what different additions take off, distance beyond what rounding explains,
gap between the spans of dates) are counted in bins, whose number is fixed, so that a two-component Gaussian mixture can
be fitted without labels to all pairs at once. Variances are regularised by the distance of the component means. During expectation-maximisation, a pair loses its
weight where it contradicts the best pair of its place or site: two sites can be the same place only if they agree with
each other, too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspan.functions.geo import haversine_km
from arcspan.llm.names import addition, parts, tokens
from arcspan.operators.spatial import leaf_salts, near_join, share_out

#: farthest two records of one place may be given, beyond rounding, in km
REACH_KM = 5.0
#: records without a name are compared with what lies within
NAMELESS_KM = 1.0
#: side of the cells by which records in reach find each other, in degrees of latitude
CELL = 0.25
#: words in at least this share of the names are generic; there can be no more than this share's inverse times a name's words
GENERIC_SHARE, GENERIC_LEAST = 1e-4, 8
SIM_BINS, KM_BIN, GAP_BIN = 50, 0.2, 0.5
#: a gap of g years counts as log(1 + g / GAP_YEARS), at most GAP_MOST, as a date may be wrong altogether
GAP_YEARS, GAP_MOST = 50.0, 3.0
#: what different additions take off the similarity of names; one record with and one without takes off half as much
ADDITION_LOSS = 0.6
#: weight of the squared distance of means in each variance, and least variances of similarity, distance and gap
KAPPA, LEAST_VAR = 0.02, np.array([1e-3, 1e-2, 0.3])
#: what so many pairs would say of each component: means and deviations; it carries tables with hardly any pairs of a kind
PRIOR_PAIRS, PRIOR = 5.0, (((0.95, 0.6, 0.4), (0.08, 0.7, 0.8)), ((0.35, 3.0, 2.3), (0.15, 1.3, 1.0)))
ROUNDS, INNER = 3, 60
#: pairs that are less likely than this come out of neither query
SEEN = 0.001
#: rows of either table in one group of a cell; fuller cells are shared out
GROUP_ROWS = 8_192


def _generic(names: DataFrame) -> frozenset[str]:
    """Words common among the names (column name, once a distinct record), with a bound on their number: see GENERIC_SHARE."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for name in b["name"]:
                seen.update({w for w in tokens(name) if addition(w) is None})
                seen["\0"] += 1
            if len(seen) > 200_000:
                yield pd.DataFrame(list(seen.items()), columns=["w", "n"])
                seen.clear()
        yield pd.DataFrame(list(seen.items()), columns=["w", "n"])

    words = names.where(F.col("name").isNotNull()).mapInPandas(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    total = words.where(F.col("w") == "\0").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = words.where((F.col("w") != "\0") & (F.col("n") >= max(GENERIC_LEAST, GENERIC_SHARE * total))).select("w").collect()
    words.unpersist()
    return frozenset(r["w"] for r in rows)


def _decimals(v: float) -> int:
    text = f"{v:.6f}".rstrip("0")
    return len(text) - text.index(".") - 1


def rounding_km(lat: float, lon: float) -> float:
    """Half the diagonal of the cell that a point's decimals stand for."""
    places = max(_decimals(lat), _decimals(lon))
    return 0.5 * 10.0**-places * 111.195 * math.hypot(1.0, math.cos(math.radians(lat)))


def _cells(lat: float, lon: float, km: float) -> list[int]:
    """Cells that a circle touches; rows of cells are CELL high, each cut into as many cells as keep about that width."""
    up = km / 111.0
    out = []
    for band in range(math.floor((max(lat - up, -90.0) + 90.0) / CELL), math.floor((min(lat + up, 90.0) + 90.0) / CELL) + 1):
        edge = min(90.0, max(abs(band * CELL - 90.0), abs((band + 1) * CELL - 90.0)))
        count = max(1, math.floor(360.0 * math.cos(math.radians(edge)) / CELL))
        wide = min(180.0, up / max(math.cos(math.radians(min(abs(lat) + up, 90.0))), 1e-9))
        first, last = math.floor((lon + 180.0 - wide) / 360.0 * count), math.floor((lon + 180.0 + wide) / 360.0 * count)
        span = range(count) if last - first + 1 >= count else range(first, last + 1)
        out += [band * 100_000 + k % count for k in span]
    return out


_ENTITY = "ent bigint, lat double, lon double, err double, low double, high double, core string, snd string, adds string, cell bigint"


def _placed(entities: DataFrame, generic: frozenset[str], reach: bool) -> DataFrame:
    """A row for each entity (ent, name, lat, lon), alias and cell; with reach, cells are those that REACH_KM touches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ent, name, lat, lon, low, high in zip(b["ent"], b["name"], b["lat"], b["lon"], b["low"], b["high"]):
                cores, sounds, adds = parts(name, generic)
                if not cores:
                    continue
                err = rounding_km(lat, lon)
                # a site's own rounding is met by the reach of the place, which takes in the coarsest usual one
                cells = _cells(lat, lon, REACH_KM + err + 0.8 if reach else err if err > 0.8 else 0.0)
                for core, snd in zip(cores, sounds):
                    out += [(ent, lat, lon, err, low, high, core, snd, adds, cell) for cell in cells]
            yield pd.DataFrame(out, columns=["ent", "lat", "lon", "err", "low", "high", "core", "snd", "adds", "cell"])

    return entities.where(F.col("name").isNotNull()).mapInPandas(run, _ENTITY)


#: names over SHORT letters are compared along a band of so many edits, as the whole table takes the product of both lengths;
#: two that need more edits are not alike
SHORT, MOST_EDITS = 400, 1000


def _edits(a: Column, b: Column) -> Column:
    """Levenshtein distance, where two edits that leave the same letters, a swap, count as one."""
    longest = F.greatest(F.length(a), F.length(b))
    banded = F.levenshtein(a, b, MOST_EDITS)
    d = F.when(longest <= SHORT, F.levenshtein(a, b)).when(banded >= 0, banded).otherwise(longest)
    swap = (d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.when(swap, F.lit(1)).otherwise(d)


def _likeness(a: Column, b: Column) -> Column:
    return 1.0 - _edits(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _additions(a: Column, b: Column) -> Column:
    """1 for equal additions, 0.5 where only one record has any, 0 for different ones."""
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.5)).otherwise(F.lit(0.0))


def _gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Scaled gap in years between two spans, 0 if they meet; null where one is missing."""
    both = low_a.isNotNull() & high_a.isNotNull() & low_b.isNotNull() & high_b.isNotNull()
    years = F.greatest(F.lit(0.0), low_a - high_b, low_b - high_a)
    return F.when(both, F.least(F.lit(GAP_MOST), F.log1p(years / GAP_YEARS)))


def candidate_pairs(places: DataFrame, sites: DataFrame, generic: frozenset[str]) -> DataFrame:
    """p, s, sim (null where a name is missing), km, adds and gap (null where a date is missing) of each candidate pair, once, with what is compared further."""
    a, b = (_placed(t, generic, reach).withColumnRenamed("cell", "leaf").persist(StorageLevel.MEMORY_AND_DISK) for t, reach in ((places, True), (sites, False)))
    # a full cell is shared out by exact counts, so that no task meets all its pairs
    a, b = share_out(a, b, leaf_salts(a, GROUP_ROWS), leaf_salts(b, GROUP_ROWS), ["ent", "core"], ["ent", "core"])
    a, b = a.alias("a"), b.alias("b")
    raw = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    km = F.greatest(F.lit(0.0), raw - F.col("a.err") - F.col("b.err"))
    sim = F.greatest(_likeness(F.col("a.core"), F.col("b.core")), _likeness(F.col("a.snd"), F.col("b.snd")))
    side = lambda x: F.struct(F.col(f"{x}.snd").alias("snd"), F.col(f"{x}.adds").alias("adds"), F.col(f"{x}.lat").alias("lat"), F.col(f"{x}.lon").alias("lon"))
    near = a.join(b, (F.col("a.leaf") == F.col("b.leaf")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))).where(km <= REACH_KM)
    named = near.select(F.col("a.ent").alias("p"), F.col("b.ent").alias("s"), sim.alias("sim"), km.alias("km"), _additions(F.col("a.adds"), F.col("b.adds")).alias("adds"), _gap(F.col("a.low"), F.col("a.high"), F.col("b.low"), F.col("b.high")).alias("gap"), side("a").alias("pa"), side("b").alias("sa"))
    best = named.groupBy("p", "s").agg(F.max("sim").alias("sim"), F.min("km").alias("km"), F.max("adds").alias("adds"), F.min("gap").alias("gap"), F.max_by("pa", "sim").alias("pa"), F.max_by("sa", "sim").alias("sa"))
    one = _nameless(places.where(F.col("name").isNull()), sites).unionByName(_nameless(places.where(F.col("name").isNotNull()), sites.where(F.col("name").isNull())))
    spans = lambda e, k: e.select(F.col("ent").alias(k), F.col("low").alias(f"{k}_low"), F.col("high").alias(f"{k}_high"))
    one = one.join(spans(places, "p"), "p").join(spans(sites, "s"), "s").withColumn("gap", _gap(F.col("p_low"), F.col("p_high"), F.col("s_low"), F.col("s_high")))
    return best.unionByName(one.select(*best.columns))


def _nameless(places: DataFrame, sites: DataFrame) -> DataFrame:
    """Pairs of which a name is missing, by distance alone."""
    key = lambda: F.concat_ws(" ", F.col("ent").cast("string"), F.col("lat").cast("string"), F.col("lon").cast("string")).alias("k")
    pairs = near_join(places.select(key(), "lat", "lon"), sites.select(key(), "lat", "lon"), "k", "k", NAMELESS_KM)
    part = lambda c, k: F.split(F.col(c), " ")[k]
    at = lambda c: (part(c, 1).cast("double"), part(c, 2).cast("double"))
    (pla, plo), (sla, slo) = at("place_key"), at("site_key")
    side = lambda la, lo: F.struct(F.lit("").alias("snd"), F.lit("").alias("adds"), la.alias("lat"), lo.alias("lon"))
    return pairs.select(part("place_key", 0).cast("long").alias("p"), part("site_key", 0).cast("long").alias("s"), F.lit(None).cast("double").alias("sim"), haversine_km(pla, plo, sla, slo).alias("km"), F.lit(1.0).alias("adds"), side(pla, plo).alias("pa"), side(sla, slo).alias("sa"))


class Mixture:
    """Two components over (similarity, km, gap), each the product of Gaussians, fitted to counted bins; NaN is a missing value and left out."""

    def __init__(self, bins: np.ndarray, counts: np.ndarray):
        self.x, self.n = bins, counts.astype(float)
        self.known = ~np.isnan(self.x)
        start = np.where(self.known[:, 0], np.nan_to_num(self.x[:, 0]), 0.4) - 0.06 * self.x[:, 1]
        self.gamma = 1.0 / (1.0 + np.exp(-25.0 * (start - 0.62)))
        self.lost = np.zeros(len(self.x))

    def fit(self, rounds: int = INNER) -> None:
        for _ in range(rounds):
            self._maximise()
            self.gamma = self.posterior()

    def _maximise(self) -> None:
        """Weights, means and regularised variances; lost is the share of each bin that transitivity took away."""
        kept = np.clip(self.gamma - self.lost, 0.0, 1.0)
        self.mean, self.var, self.weight = [], [], []
        x = np.where(self.known, self.x, 0.0)
        for g, (prior_mean, prior_sd) in zip((kept, 1.0 - kept), map(np.array, PRIOR)):
            w = (g * self.n)[:, None] * self.known
            self.weight.append((g * self.n).sum() + PRIOR_PAIRS)
            total = w.sum(0) + PRIOR_PAIRS
            mean = ((w * x).sum(0) + PRIOR_PAIRS * prior_mean) / total
            self.mean.append(mean)
            self.var.append(((w * (x - mean) ** 2).sum(0) + PRIOR_PAIRS * (prior_sd**2 + (prior_mean - mean) ** 2)) / total)
        self.var = [v + KAPPA * (self.mean[0] - self.mean[1]) ** 2 + LEAST_VAR for v in self.var]
        self.weight = [w / sum(self.weight) for w in self.weight]

    def posterior(self) -> np.ndarray:
        logs = [math.log(w) + np.where(self.known, -0.5 * (np.nan_to_num(self.x) - m) ** 2 / v - 0.5 * np.log(2 * math.pi * v), 0.0).sum(1) for w, m, v in zip(self.weight, self.mean, self.var)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))


def _agree(a: Column, b: Column) -> Column:
    """Whether two records of one table may be the same place."""
    same_name = (a["snd"] == "") | (b["snd"] == "") | (_likeness(a["snd"], b["snd"]) >= 0.75)
    return same_name & (a["adds"] == b["adds"]) & (haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]) <= 2 * REACH_KM)


def _transitive(strong: DataFrame) -> DataFrame:
    """Column kept: 0 for a pair that contradicts the best pair of its place or of its site, else its gamma."""
    rank = [F.col("gamma").desc(), F.col("sim").desc_nulls_last(), F.col("km"), F.col("s"), F.col("p")]
    by_place, by_site = Window.partitionBy("p").orderBy(*rank), Window.partitionBy("s").orderBy(*rank)
    seen = strong.withColumn("top_site", F.first("sa").over(by_place)).withColumn("top_place", F.first("pa").over(by_site))
    return seen.withColumn("kept", F.when(_agree(F.col("sa"), F.col("top_site")) & _agree(F.col("pa"), F.col("top_place")), F.col("gamma")).otherwise(F.lit(0.0))).drop("top_site", "top_place")


def match(places: DataFrame, sites: DataFrame) -> DataFrame:
    """place, site and confidence of each pair that is the same real place with a posterior of at least SEEN; 0 for one that contradicts a better pair.

    places: id, name, lat, lon, low and high (span of calendar years, both or neither); sites: the same, one row an id. Coordinates with a
    latitude beyond 90 degrees whose other value is none are taken as swapped; records with no usable coordinates make no
    pair. Records equal in all of this are compared once and come out each. Null ids are left out; null and blank names
    are compared by place and dates alone, missing dates not at all; empty tables give no rows.
    """
    places, sites = (t if {"low", "high"} <= set(t.columns) else t.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}) for t in (places, sites))
    members_p, ents_p = _collapse(places)
    members_s, ents_s = _collapse(sites)
    generic = _generic(ents_p.select("name").unionByName(ents_s.select("name")))
    lowered = F.col("sim") - ADDITION_LOSS * (1.0 - F.col("adds"))
    pairs = candidate_pairs(ents_p, ents_s, generic)
    pairs = pairs.withColumns({"bs": F.coalesce(F.round(lowered * SIM_BINS).cast("int"), F.lit(-1000)), "bk": F.floor(F.col("km") / KM_BIN).cast("int"), "bg": F.coalesce(F.floor(F.col("gap") / GAP_BIN).cast("int"), F.lit(-1))})
    pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
    # at most 82 similarities, 26 distances and 8 gaps, a fixed number of rows
    bins = pairs.groupBy("bs", "bk", "bg").agg(F.count("*").alias("n")).collect()
    spark = places.sparkSession
    if not bins:
        return _expand(pairs.select("p", "s").limit(0).withColumn("kept", F.lit(0.0)), members_p, members_s)
    keys = [(r["bs"], r["bk"], r["bg"]) for r in bins]
    x = np.array([(np.nan if s == -1000 else s / SIM_BINS, (k + 0.5) * KM_BIN, np.nan if g < 0 else min((g + 0.5) * GAP_BIN if g else 0.1, GAP_MOST)) for s, k, g in keys])
    mixture = Mixture(x, np.array([r["n"] for r in bins]))
    mixture.fit()
    for turn in range(ROUNDS):
        seen = spark.createDataFrame([(*k, float(g)) for k, g in zip(keys, mixture.gamma) if g >= SEEN], "bs int, bk int, bg int, gamma double")
        strong = _transitive(pairs.join(F.broadcast(seen), ["bs", "bk", "bg"]))
        if turn == ROUNDS - 1:
            break
        lost = {(r["bs"], r["bk"], r["bg"]): r["lost"] for r in strong.groupBy("bs", "bk", "bg").agg(F.avg(F.col("gamma") - F.col("kept")).alias("lost")).collect()}
        mixture.lost = np.array([lost.get(k, 0.0) for k in keys])
        mixture.fit(10)
    return _expand(strong.select("p", "s", "kept"), members_p, members_s)


def _collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ent, id) for each record and (ent, name, lat, lon, low, high) for each distinct one with usable coordinates."""
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    swapped = (F.abs(lat) > 90) & (F.abs(lon) <= 90)
    la, lo = F.when(swapped, lon).otherwise(lat), F.when(swapped, lat).otherwise(lon)
    spans = [F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) for c in ("low", "high")]
    good = rows.where(F.col("id").isNotNull()).select("id", F.when(F.trim("name") != "", F.trim("name")).alias("name"), la.alias("lat"), lo.alias("lon"), *spans)
    good = good.where(F.col("lat").between(-90, 90) & (F.abs("lon") < 1e9) & ~((F.col("lat") == 0) & (F.col("lon") == 0))).withColumn("lon", F.round(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0, 7))
    keyed = good.withColumn("ent", F.xxhash64("name", "lat", "lon", "low", "high")).persist(StorageLevel.MEMORY_AND_DISK)
    entities = keyed.groupBy("ent").agg(*[F.first(c).alias(c) for c in ("name", "lat", "lon", "low", "high")])
    return keyed.select("ent", "id"), entities.persist(StorageLevel.MEMORY_AND_DISK)


def _expand(pairs: DataFrame, members_p: DataFrame, members_s: DataFrame) -> DataFrame:
    out = pairs.join(members_p.select(F.col("ent").alias("p"), F.col("id").alias("place")), "p").join(members_s.select(F.col("ent").alias("s"), F.col("id").alias("site")), "s")
    return out.groupBy("place", "site").agg(F.max("kept").alias("confidence"))


def site_spans(years: DataFrame) -> DataFrame:
    """id, low and high: tenth and ninetieth percentile of the years (rec_key, year) of each site, approximate, so that stray dates do not stretch it."""
    p = years.groupBy(F.col("rec_key").alias("id")).agg(F.percentile_approx("year", F.array(F.lit(0.1), F.lit(0.9)), 200).alias("p"))
    return p.select("id", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def site_profiles(dates: DataFrame, site: str, name: str, lat: str, lon: str) -> DataFrame:
    """id, name, lat and lon of each site: its commonest name and its commonest usable coordinates, of ties the finest."""
    usable = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.abs("lat") <= 180) & (F.abs("lon") < 1e9) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    inside = F.abs("lat") <= 90
    kinds = dates.where(F.coalesce(F.trim(site) != "", F.lit(False))).select(F.col(site).alias("id"), F.trim(F.col(name)).alias("name"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).groupBy("id", "name", "lat", "lon").agg(F.count("*").alias("n"))
    finer = F.length(F.col("lat").cast("string")) + F.length(F.col("lon").cast("string"))
    return kinds.groupBy("id").agg(
        F.max_by("name", F.when(F.col("name") != "", F.struct("n", "name"))).alias("name"),
        F.max_by(F.struct("lat", "lon"), F.when(usable & ~F.isnan("lat") & ~F.isnan("lon"), F.struct(inside.alias("i"), F.col("n").alias("n"), finer.alias("f"), F.col("lat").alias("a"), F.col("lon").alias("o")))).alias("at"),
    ).select("id", F.when(F.col("name") != "", F.col("name")).alias("name"), "at.lat", "at.lon")
