"""Rank, correlation and regression statistics, tests, K-functions, spectra."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_BUCKETS = 64


def average_rank(df: DataFrame, column: str, name: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Adds the 1-based mean rank of a column; null values get none.

    Ranks are made on distinct values with their counts, so that ties cost nothing; these are cut into buckets at
    approximate quantiles, ranked within, and shifted by the exact counts of the buckets before.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    edges = sorted(set(df.approxQuantile(column, [k / buckets for k in range(1, buckets)], 0.01)))
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("__v"))) if edges else F.lit(0)
    values = values.withColumn("__b", bucket)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = values.groupBy("__b").agg(F.sum("__n").alias("__m")).withColumn("__shift", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    inner = Window.partitionBy("__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(F.broadcast(shift), "__b")
    ranked = ranked.select("__v", (F.col("__shift") + F.col("__in") + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(ranked, F.col(column) == F.col("__v"), "left").drop("__v")


def pearson(x: str, y: str) -> Column:
    return F.corr(F.col(x).cast("double"), F.col(y).cast("double"))


def spearman(df: DataFrame, x: str, y: str, name: str = "rho") -> DataFrame:
    """Correlation of mean ranks; rows with a null in either column are left out before ranking."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_rank(average_rank(both, x, "__rx"), y, "__ry").agg(F.corr("__rx", "__ry").alias(name))


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Rank correlation of x and y with z held."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    for c, r in ((x, "__rx"), (y, "__ry"), (z, "__rz")):
        full = average_rank(full, c, r)
    r = full.agg(F.corr("__rx", "__ry").alias("xy"), F.corr("__rx", "__rz").alias("xz"), F.corr("__ry", "__rz").alias("yz"))
    return r.select(((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("rho"))


def normal_tail(z: Column) -> Column:
    """P(Z > z), by the series and continued-fraction free approximation of the error function with error below 1.2e-7."""
    a = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * a)
    poly = F.lit(0.17087277)
    # fixed values: coefficients of the Chebyshev fit of erfc, highest power first
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = 0.5 * t * F.exp(-a * a + poly)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def mann_whitney(df: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """u, n1, n2, z (tie-corrected) and two-sided p for the first group against all others."""
    ranked = average_rank(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()), value, "__r")
    ties = ranked.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    s = ranked.agg(F.sum(F.when(F.col(group) == first, F.col("__r"))).alias("r1"), F.count_if(F.col(group) == first).cast("double").alias("n1"), F.count_if(F.col(group) != first).cast("double").alias("n2"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    out = s.withColumn("k", F.lit(0)).join(ties.withColumn("k", F.lit(0)), "k").withColumn("u", u).withColumn("z", (u - F.col("n1") * F.col("n2") / 2) / F.sqrt(var))
    return out.select("u", "n1", "n2", "z", F.least(F.lit(1.0), 2 * normal_tail(F.abs("z"))).alias("p"))


def benjamini_hochberg(df: DataFrame, p: str, name: str = "p_bh") -> DataFrame:
    """Step-up adjusted p-values of a list of tests, each cut at 1. The list is one window: it holds tests, not rows of data."""
    ordered = Window.orderBy(p, *[c for c in df.columns if c != p])
    everything = Window.partitionBy(F.lit(0))
    down = Window.orderBy(F.col("__k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.where(F.col(p).isNotNull()).withColumn("__k", F.row_number().over(ordered)).withColumn("__m", F.count("*").over(everything))
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__k")).over(down))).drop("__k", "__m")


def residuals(df: DataFrame, x: str, y: str, name: str = "residual") -> DataFrame:
    """Adds y less its least-squares line over x; the two coefficients are one row, joined by broadcast."""
    line = df.agg(F.regr_slope(F.col(y), F.col(x)).alias("__slope"), F.regr_intercept(F.col(y), F.col(x)).alias("__at")).withColumn("__k", F.lit(0))
    return df.withColumn("__k", F.lit(0)).join(F.broadcast(line), "__k").withColumn(name, F.col(y) - F.col("__at") - F.col("__slope") * F.col(x)).drop("__k", "__slope", "__at")


def granger(series: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """F of lag-1 causation of y by x within each group, from the sums of both regressions; n of at least 5, else null."""
    w = Window.partitionBy(*by).orderBy(order)
    pairs = series.withColumns({"y1": F.lag(y).over(w), "x1": F.lag(x).over(w), "y0": F.col(y)}).where("y1 is not null and x1 is not null and y0 is not null")
    s = pairs.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in (("y0", "y0"), ("y1", "y1"), ("x1", "x1"), ("y0", "y1"), ("y0", "x1"), ("y1", "x1"))]
    )
    c = lambda a, b: F.col(f"{a}_{b}")
    rss1 = c("y0", "y0") - F.try_divide(c("y0", "y1") ** 2, c("y1", "y1"))
    det = c("y1", "y1") * c("x1", "x1") - c("y1", "x1") ** 2
    by1 = F.try_divide(c("y0", "y1") * c("x1", "x1") - c("y0", "x1") * c("y1", "x1"), det)
    bx1 = F.try_divide(c("y0", "x1") * c("y1", "y1") - c("y0", "y1") * c("y1", "x1"), det)
    rss2 = c("y0", "y0") - by1 * c("y0", "y1") - bx1 * c("y0", "x1")
    f = F.when(F.col("n") >= 5, F.try_divide((rss1 - rss2) * F.col("n"), rss2 * F.col("n") / (F.col("n") - 3)))
    return s.select(*by, F.col("n").cast("long").alias("n"), f.alias("f"))


def morans_i(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """I over neighbours in order, the ends not joined: (n / (n - 1)) * sum d[i] d[i+1] / sum d^2, by group."""
    by = by or []
    key = by or [F.lit(0)]
    w = Window.partitionBy(*key)
    d = df.withColumn("__d", F.col(value) - F.avg(value).over(w)).withColumn("__next", F.lead("__d").over(w.orderBy(order)))
    n = F.count("*")
    return d.groupBy(*by).agg(n.alias("n"), F.try_divide(n * F.sum(F.col("__d") * F.col("__next")), (n - 1) * F.sum(F.col("__d") ** 2)).alias("i"))


def lag_correlation(df: DataFrame, order: str, value: str, by: list[str], lag: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__p", F.lag(value, lag).over(w)).groupBy(*by).agg(F.corr(F.col("__p").cast("double"), F.col(value).cast("double")).alias("r"), F.count("__p").alias("n"))


def power_at(df: DataFrame, angle: str, frequencies: list[int], weight: str | None = None) -> DataFrame:
    """frequency and power |sum w exp(-i f a)|^2 of angles in degrees; one pass, one row a frequency moves."""
    w = F.col(weight) if weight else F.lit(1.0)
    waves = df.select(F.radians(F.col(angle)).alias("a"), w.alias("w")).withColumn("frequency", F.explode(F.array(*map(F.lit, frequencies))))
    return waves.groupBy("frequency").agg((F.pow(F.sum(F.col("w") * F.cos(F.col("a") * F.col("frequency"))), 2) + F.pow(F.sum(F.col("w") * F.sin(F.col("a") * F.col("frequency"))), 2)).alias("power"))


def wrapped_density(df: DataFrame, angle: str, points: int, bandwidth: float, bin_deg: float = 0.25) -> DataFrame:
    """at (degrees) and density of a Gaussian kernel on the circle, at equal points; angles are counted in narrow bins first."""
    bins = df.select((F.floor(F.pmod(F.col(angle), F.lit(360.0)) / bin_deg) * bin_deg + bin_deg / 2).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    step = 360.0 / points
    grid = bins.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    gap = F.abs(F.pmod(F.col("k") * step - F.col("c") + 180.0, F.lit(360.0)) - 180.0)
    return grid.groupBy("k").agg(F.sum(F.col("n") * F.exp(-0.5 * F.pow(gap / bandwidth, 2)) / (bandwidth * math.sqrt(2 * math.pi))).alias("density")).select((F.col("k") * step).alias("at"), "density")


def ripley(bands: DataFrame, radii: list[float], n: int, area: float) -> DataFrame:
    """radius, pairs, k and l (no edge correction) from the unordered pairs in the bands between 0 and the radii (band, pairs)."""
    counted = bands.groupBy(F.lit(0).alias("g")).agg(*[F.coalesce(F.sum(F.when(F.col("band") <= k, F.col("pairs"))), F.lit(0)).alias(f"n{k}") for k, _ in enumerate(radii)])
    out = counted.select(F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"n{k}").alias("pairs")) for k, r in enumerate(radii)])).alias("x")).select("x.*")
    k = F.try_divide(F.lit(float(area)), F.lit(float(n) * (n - 1))) * (2 * F.col("pairs"))
    return out.withColumn("k", k).withColumn("l", F.sqrt(k / math.pi) - F.col("radius"))


def directional_k(points: DataFrame, key: str, along: str, perp: str, radii: list[float], n: int, area: float) -> DataFrame:
    """radius, pairs_parallel, pairs_across, k_parallel and k_across of points in the plane of two distances in km.

    A pair within a radius is parallel if it lies farther apart along the line than across it. Points meet in square cells
    as wide as the largest radius; counts are summed before anything is shuffled again.
    """
    wide = float(max(radii))
    p = points.where(F.col(along).isNotNull() & F.col(perp).isNotNull()).select(F.col(key).alias("id"), F.col(along).alias("x"), F.col(perp).alias("y"))
    cell = lambda c: F.floor(F.col(c) / wide)
    own = p.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    beside = own.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(near).alias("o")).select("id2", "x2", "y2", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    dx, dy = F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2"))
    pairs = own.join(beside, ["cx", "cy"]).where(F.col("id") < F.col("id2")).select((dx > dy).alias("parallel"), F.sqrt(dx * dx + dy * dy).alias("km")).where(F.col("km") <= wide)
    counted = pairs.groupBy("parallel").agg(*[F.count_if(F.col("km") <= r).alias(f"n{k}") for k, r in enumerate(radii)])
    long = counted.select("parallel", F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"n{k}").alias("pairs")) for k, r in enumerate(radii)])).alias("q")).select("parallel", "q.*")
    out = long.groupBy("radius").agg(F.coalesce(F.sum(F.when(F.col("parallel"), F.col("pairs"))), F.lit(0)).alias("pairs_parallel"), F.coalesce(F.sum(F.when(~F.col("parallel"), F.col("pairs"))), F.lit(0)).alias("pairs_across"))
    unit = F.try_divide(F.lit(float(area)), F.lit(float(n) * (n - 1))) * 2
    return out.withColumns({"k_parallel": unit * F.col("pairs_parallel"), "k_across": unit * F.col("pairs_across")})


def two_by_two(df: DataFrame, row: Column, col: Column) -> DataFrame:
    """a, b, c, d, odds (null for an empty margin), chi2 and the one-sided Fisher p (at least a) of a 2 x 2 table.

    Counts are summed in the JVM; the hypergeometric tail is summed by logarithms in one Arrow row.
    """
    t = df.select(row.alias("r"), col.alias("c")).where("r is not null and c is not null").agg(
        F.count_if(F.col("r") & F.col("c")).alias("a"), F.count_if(F.col("r") & ~F.col("c")).alias("b"), F.count_if(~F.col("r") & F.col("c")).alias("c"), F.count_if(~F.col("r") & ~F.col("c")).alias("d")
    )

    def tail(batches):
        for g in batches:
            out = []
            for a, b, c, d in zip(g["a"], g["b"], g["c"], g["d"]):
                n, k, m = a + b + c + d, a + b, a + c
                lg = math.lgamma
                log = lambda x: lg(k + 1) - lg(x + 1) - lg(k - x + 1) + lg(n - k + 1) - lg(m - x + 1) - lg(n - k - m + x + 1) - (lg(n + 1) - lg(m + 1) - lg(n - m + 1))  # noqa: B023, E731
                out.append(min(1.0, math.fsum(math.exp(log(x)) for x in range(a, min(k, m) + 1))))
            yield g.assign(p=out)

    v = lambda c: F.col(c).cast("double")
    n = v("a") + v("b") + v("c") + v("d")
    chi = F.try_divide(n * (v("a") * v("d") - v("b") * v("c")) ** 2, (v("a") + v("b")) * (v("c") + v("d")) * (v("a") + v("c")) * (v("b") + v("d")))
    return t.mapInPandas(tail, "a bigint, b bigint, c bigint, d bigint, p double").select("a", "b", "c", "d", F.try_divide(v("a") * v("d"), v("b") * v("c")).alias("odds"), chi.alias("chi2"), "p")


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, first: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """d (greatest gap of the two empirical distributions), n1, n2, over distinct values in buckets with exact counts before."""
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == first).alias("x"), F.count_if(F.col(group) != first).alias("y"))
    edges = sorted(set(df.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.01)))
    counts = counts.withColumn("b", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("v"))) if edges else F.lit(0))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(F.lit(0))
    shift = counts.groupBy("b").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy")).select("b", F.coalesce(F.sum("sx").over(w), F.lit(0)).alias("bx"), F.coalesce(F.sum("sy").over(w), F.lit(0)).alias("by"), F.sum("sx").over(all_of).alias("n1"), F.sum("sy").over(all_of).alias("n2"))
    inner = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs((F.col("bx") + F.sum("x").over(inner)) / F.col("n1") - (F.col("by") + F.sum("y").over(inner)) / F.col("n2"))
    return counts.join(F.broadcast(shift), "b").withColumn("gap", gap).agg(F.max("gap").alias("d"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))


def cohens_d(df: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """Difference of means of the first group and all others over their pooled deviation."""
    x, y = F.when(F.col(group) == first, F.col(value)), F.when(F.col(group) != first, F.col(value))
    s = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.count(x).alias("n1"), F.count(y).alias("n2"))
    return s.select("n1", "n2", ((F.col("mx") - F.col("my")) / F.sqrt(((F.col("n1") - 1) * F.col("vx") + (F.col("n2") - 1) * F.col("vy")) / (F.col("n1") + F.col("n2") - 2))).alias("d"))


def global_moran(points: DataFrame, key: str, value: str, km: float) -> DataFrame:
    """i, n and weight sum of Moran's I with inverse-distance weights over all pairs of rows more than 0 and at most km apart.

    Every leaf gives one row of sums; the mean is taken off beforehand, so the pairs themselves are never rows.
    """
    from arcspan.operators.spatial import near_apply, usable_points

    known = points.where(F.col(value).isNotNull())
    m = known.agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count(value).alias("n")).first()
    rows = usable_points(known, "lat", "lon", F.col(key).alias("a"), (F.col(value).cast("double") - F.lit(m["m"] or 0.0)).alias("z"))

    def refine(p, s, hits):
        w = c = 0.0
        pz, sz = p["z"].to_numpy(), s["z"].to_numpy()
        for at, item, far in hits:
            ok = far > 0
            at, item, far = at[ok], item[ok], far[ok]
            w += float((1.0 / far).sum())
            c += float((pz[at] * sz[item] / far).sum())
        return pd.DataFrame({"w": [w], "c": [c]})

    s = near_apply(rows, rows, km, refine, "w double, c double").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
    return s.select(F.try_divide(F.col("c"), F.col("w") * F.lit(float(m["v"] or 0.0))).alias("i"), F.lit(m["n"]).alias("n"), "w")
