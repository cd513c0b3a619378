"""Queries of Monte-Carlo divergences, further nulls, probabilities of tests and composite analyses."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from arcspan.functions import classify, dates, geo
from arcspan.functions.geo import circle_km, haversine_km
from arcspan.operators import circular, dedup, nulls, poles, pvalues, stats
from arcspan.operators.ranking import rank_within
from arcspan.plans.reference import _CAL1, _DATES, _frame_sql, r6, radiocarbon, sites
from arcspan.plans.reference_stats import _USERDAY, _days, _turns, _TURN
from arcspan.plans.runtime import not_blank, table
from arcspan.plans.sqltext import SITES, bearing, circle, hav

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TRIALS, FAST, NEAR_KM = 200, 30, 200.0


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# --- divergence of two classes ------------------------------------------------------------------------------------------


def _class_null_sql(trials: int, seed: int = 42, cls: str = "cls", where: str = "cls <> 'other'") -> str:
    """nn: cls, trial, lat, lon of the null of each class; s0: the observed sites by class."""
    lat = f"greatest(-90.0, least(90.0, b.lat + 2.0 * {nulls.normal_sql(seed + 2, 'd.trial', 'd.row')}))"
    lon = f"greatest(-180.0, least(180.0, b.lon + 2.0 * {nulls.normal_sql(seed + 4, 'd.trial', 'd.row')}))"
    return f"""s0 AS (SELECT {cls} AS cls, id, lat, lon FROM sites WHERE {where}), r0 AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY id) - 1 AS row, count(*) OVER (PARTITION BY cls) AS n FROM s0),
d0 AS (SELECT cls, row, t.range AS trial, {nulls.draw_int_sql(seed, 't.range', 'row')} % n AS i FROM r0, range({trials}) t), nn AS (SELECT d.cls, d.trial, {lat} AS lat, {lon} AS lon FROM d0 d JOIN r0 b ON b.cls = d.cls AND b.row = d.i)"""


_Z = f"""o AS (SELECT cls, count(*) AS total, count(*) FILTER (WHERE {circle()} <= {NEAR_KM}) AS obs FROM s0 GROUP BY cls), c AS (SELECT cls, trial, count(*) FILTER (WHERE {circle()} <= {NEAR_KM}) AS n FROM nn GROUP BY cls, trial),
z AS (SELECT c.cls, any_value(total) AS total, any_value(obs) AS obs, avg(n) AS mu, stddev_pop(n) AS sd, CASE WHEN stddev_pop(n) > 1e-12 THEN (any_value(obs) - avg(n)) / stddev_pop(n) ELSE 0 END AS z FROM c JOIN o ON o.cls = c.cls GROUP BY c.cls)"""


def class_z(s, trials: int, km: float = NEAR_KM, seed: int = 42):
    """cls, observed, mu, sigma, z ... of each class of sites (cls, id, lat, lon) against its own joint null."""
    near = F.count_if(circle_km("lat", "lon") <= km)
    null = nulls.class_nulls(s, trials, seed).groupBy("cls", "trial").agg(near.alias("n"))
    return nulls.null_summary(s.groupBy("cls").agg(near.alias("n")), null, ["cls"], trials)


@query("mc_divergence", f"WITH {SITES}, {_class_null_sql(TRIALS)}, {_Z} SELECT max(obs) FILTER (WHERE cls = 'monument') AS monuments, max(obs) FILTER (WHERE cls = 'settlement') AS settlements, round(max(z) FILTER (WHERE cls = 'monument'), 6) AS z_monuments, round(max(z) FILTER (WHERE cls = 'settlement'), 6) AS z_settlements, round(max(z) FILTER (WHERE cls = 'monument') - max(z) FILTER (WHERE cls = 'settlement'), 6) AS divergence FROM z")
def q_mc_divergence(spark, d):
    """D: z of one class less z of the other, each against its own joint null of 200 trials."""
    z = class_z(sites(spark, d).where("cls <> 'other'").select("cls", "id", "lat", "lon"), TRIALS)
    only = lambda k, v: F.max(F.when(F.col("cls") == k, F.col(v)))
    return z.agg(only("monument", "observed").alias("monuments"), only("settlement", "observed").alias("settlements"), r6(only("monument", "z")).alias("z_monuments"), r6(only("settlement", "z")).alias("z_settlements"), r6(only("monument", "z") - only("settlement", "z")).alias("divergence"))


_HALF = "CASE WHEN lon >= -180 AND lon < -20 THEN 'new' WHEN lon >= 20 OR lat < 35 THEN 'old' END"


@query("hemisphere_divergence", f"WITH {SITES}, {_class_null_sql(TRIALS, 42, f'({_HALF}) || chr(58) || cls', f'cls <> {chr(39)}other{chr(39)} AND ({_HALF}) IS NOT NULL')}, {_Z} SELECT split_part(cls, ':', 1) AS half, sum(total)::BIGINT AS sites, round(max(z) FILTER (WHERE cls LIKE '%:monument') - max(z) FILTER (WHERE cls LIKE '%:settlement'), 6) AS divergence FROM z GROUP BY 1")
def q_hemispheres(spark, d):
    """D in the new world and in the old one outside Europe."""
    half = F.when((F.col("lon") >= -180) & (F.col("lon") < -20), "new").when((F.col("lon") >= 20) | (F.col("lat") < 35), "old")
    s = sites(spark, d).where("cls <> 'other'").withColumn("half", half).where("half is not null").select(F.concat_ws(":", "half", "cls").alias("cls"), "id", "lat", "lon")
    z = class_z(s, TRIALS).join(s.groupBy("cls").agg(F.count("*").alias("total")), "cls").select(F.split("cls", ":")[0].alias("half"), F.split("cls", ":")[1].alias("part"), "total", "z")
    only = lambda k: F.max(F.when(F.col("part") == k, F.col("z")))
    return z.groupBy("half").agg(F.sum("total").alias("sites"), r6(only("monument") - only("settlement")).alias("divergence"))


POLE_N = 40


def _by_pole_sql(trials: int, prefix: str) -> str:
    near = f"count(*) FILTER (WHERE abs({hav('lat', 'lon', 'plat', 'plon')} - {geo.QUARTER_KM!r}) <= {NEAR_KM})"
    return f"""{prefix}o AS (SELECT pole_id, cls, {near} AS obs FROM s0, poles GROUP BY ALL), {prefix}c AS (SELECT pole_id, cls, trial, {near} AS n FROM nn, poles WHERE trial < {trials} GROUP BY ALL),
{prefix}z AS (SELECT c.pole_id, c.cls, CASE WHEN stddev_pop(n) > 1e-12 THEN (any_value(obs) - avg(n)) / stddev_pop(n) ELSE 0 END AS z FROM {prefix}c c JOIN {prefix}o o ON o.pole_id = c.pole_id AND o.cls = c.cls GROUP BY ALL),
{prefix}d AS (SELECT pole_id, max(z) FILTER (WHERE cls = 'monument') - max(z) FILTER (WHERE cls = 'settlement') AS d FROM {prefix}z GROUP BY pole_id)"""


_NEAR_POLES = f"""numbered AS (SELECT row_number() OVER (ORDER BY id) - 1 AS row, lat, lon, count(*) OVER () AS n FROM sites), poles AS (SELECT p.range AS pole_id, greatest(-90.0, least(90.0, a.lat + 10.0 * {nulls.normal_sql(19, 'p.range', '0')})) AS plat, ((((b.lon + 10.0 * {nulls.normal_sql(21, 'p.range', '0')} + 180) % 360) + 360) % 360) - 180 AS plon
FROM range({POLE_N}) p JOIN numbered a ON a.row = {nulls.draw_int_sql(17, 'p.range', '0')} % a.n JOIN numbered b ON b.row = {nulls.draw_int_sql(18, 'p.range', '0')} % b.n)"""


def divergence_by_pole(s, null, at: list[tuple], trials: int, km: float = NEAR_KM, floor_sigma: float = 0.0):
    """pole_id and d for each pole: all poles are counted over one set of null points (cls, trial, lat, lon), as blocks of matrix products."""
    tagged = null.where(F.col("trial") < trials).select(F.concat_ws("|", "cls", F.col("trial").cast("string")).alias("cls"), "lat", "lon").unionByName(s.select(F.concat("cls", F.lit("|o")).alias("cls"), "lat", "lon"))
    c = poles.pole_counts(tagged, at, km, "cls").select("pole_id", F.split("cls", r"\|")[0].alias("cls"), F.split("cls", r"\|")[1].alias("trial"), "n")
    of = F.col("trial") != "o"
    z = c.groupBy("pole_id", "cls").agg(F.max(F.when(~of, F.col("n"))).alias("obs"), (F.sum(F.when(of, F.col("n"))) / trials).alias("mu"), (F.sum(F.when(of, F.col("n") * F.col("n"))) / trials).alias("ss"))
    sd = F.greatest(F.lit(floor_sigma), F.sqrt(F.greatest(F.col("ss") - F.col("mu") * F.col("mu"), F.lit(0.0))))
    z = z.withColumn("sd", sd).withColumn("z", F.when(F.col("sd") > 1e-6, (F.col("obs") - F.col("mu")) / F.col("sd")).otherwise(0.0))
    return z.groupBy("pole_id").agg((F.max(F.when(F.col("cls") == "monument", F.col("z"))) - F.max(F.when(F.col("cls") == "settlement", F.col("z")))).alias("d"))


@query("divergence_two_stage", f"WITH {SITES}, {_class_null_sql(TRIALS)}, {_NEAR_POLES}, {_by_pole_sql(FAST, 'f')}, {_by_pole_sql(TRIALS, 'p')}, {_Z}, own AS (SELECT max(z) FILTER (WHERE cls = 'monument') - max(z) FILTER (WHERE cls = 'settlement') AS d FROM z) SELECT f.pole_id, round(f.d, 5) AS fast, CASE WHEN f.d >= 0.7 * own.d THEN round(p.d, 5) END AS precise FROM fd f JOIN pd p ON p.pole_id = f.pole_id, own")
def q_two_stage(spark, d):
    """D of circles with poles near sites by few trials, those with at least 0.7 of the default circle's D again by all trials."""
    everything = sites(spark, d)
    s = everything.where("cls <> 'other'").select("cls", "id", "lat", "lon")
    null = nulls.class_nulls(s, TRIALS)
    numbered = everything.select(F.col("id").alias("row"), "lat", "lon")  # ids are dense from 0 here
    drawn = nulls.poles_near(numbered, numbered.count(), POLE_N, 17).collect()  # as many as were asked for
    at = [(r["pole_id"], r["lat"], r["lon"]) for r in drawn]
    own = q_mc_divergence(spark, d).first()["divergence"]
    fast = divergence_by_pole(s, null, at, FAST).collect()  # one row a pole
    close = {r["pole_id"] for r in fast if r["d"] is not None and r["d"] >= 0.7 * own}
    again = divergence_by_pole(s, null, [p for p in at if p[0] in close], TRIALS) if close else None
    out = spark.createDataFrame([(r["pole_id"], r["d"]) for r in fast], "pole_id long, fast double")
    out = out.join(again.withColumnRenamed("d", "precise"), "pole_id", "left") if again is not None else out.withColumn("precise", F.lit(None).cast("double"))
    return out.select("pole_id", r6("fast", 5).alias("fast"), r6("precise", 5).alias("precise"))


_STEPS = f"poles AS (SELECT (a.range + 2) * 5 + b.range + 2 AS pole_id, {geo.DEFAULT_POLE[0]} + a.range * 2.0 AS plat, {geo.DEFAULT_POLE[1]} + b.range * 2.0 AS plon FROM range(-2, 3) a, range(-2, 3) b)"


@query("sensitivity_surface", f"WITH {SITES}, {_class_null_sql(FAST)}, {_STEPS}, {_by_pole_sql(FAST, 'f').replace('CASE WHEN stddev_pop(n) > 1e-12 THEN (any_value(obs) - avg(n)) / stddev_pop(n) ELSE 0 END', '(any_value(obs) - avg(n)) / greatest(stddev_pop(n), 1.0)')} SELECT plat AS lat, plon AS lon, round(d, 5) AS divergence FROM fd JOIN poles USING (pole_id)")
def q_surface(spark, d):
    """D of the circles whose poles lie in steps of 2 degrees around the default one, deviations held at 1 at least."""
    s = sites(spark, d).where("cls <> 'other'").select("cls", "id", "lat", "lon")
    at = [((a + 2) * 5 + b + 2, geo.DEFAULT_POLE[0] + a * 2.0, geo.DEFAULT_POLE[1] + b * 2.0) for a in range(-2, 3) for b in range(-2, 3)]
    by = divergence_by_pole(s, nulls.class_nulls(s, FAST), at, FAST, floor_sigma=1.0)
    return by.join(F.broadcast(spark.createDataFrame(at, "pole_id long, lat double, lon double")), "pole_id").select("lat", "lon", r6("d", 5).alias("divergence"))


_EPOCHS = "CASE WHEN bal < 0 THEN 'first' WHEN bal < 5000 THEN 'second' ELSE 'third' END"


@query("epoch_z", f"WITH {SITES}, {_class_null_sql(TRIALS, 42, _EPOCHS, 'TRUE')}, {_Z} SELECT cls AS epoch, total, obs AS observed, round(mu, 5) AS mu, round(z, 5) AS z FROM z")
def q_epochs(spark, d):
    """z of each epoch of sites against its own null."""
    epoch = F.when(F.col("bal") < 0, "first").when(F.col("bal") < 5000, "second").otherwise("third")
    s = sites(spark, d).select(epoch.alias("cls"), "id", "lat", "lon")
    z = class_z(s, TRIALS).join(s.groupBy("cls").agg(F.count("*").alias("total")), "cls")
    return z.select(F.col("cls").alias("epoch"), "total", "observed", r6("mu", 5).alias("mu"), r6("z", 5).alias("z"))


# --- further nulls ------------------------------------------------------------------------------------------------------


@query("gaussian_cloud_null", f"WITH p AS (SELECT a.range AS trial, greatest(-90.0, least(90.0, 27.3 + 2.0 * {nulls.normal_sql(33, 'a.range', 'b.range')})) AS lat, greatest(-180.0, least(180.0, 68.1 + 3.0 * {nulls.normal_sql(35, 'a.range', 'b.range')})) AS lon FROM range({TRIALS}) a, range(500) b) SELECT trial, count(*) FILTER (WHERE {circle()} <= 100) AS n FROM p GROUP BY trial")
def q_cloud(spark, d):
    return nulls.gaussian_cloud(spark, TRIALS, 500, (27.3, 68.1), (2.0, 3.0), 33).groupBy("trial").agg(F.count_if(circle_km("lat", "lon") <= 100).alias("n"))


@query("toroidal_null", f"WITH {SITES}, t AS (SELECT range AS trial, {nulls.uniform_sql(37, 'range', '0')} AS u, {nulls.uniform_sql(38, 'range', '0')} AS v FROM range({TRIALS})), p AS (SELECT trial, ((lat + 90 + 180 * u) % 180) - 90 AS lat, ((lon + 180 + 360 * v) % 360) - 180 AS lon FROM sites, t) SELECT trial, count(*) FILTER (WHERE {circle()} <= {NEAR_KM}) AS n FROM p GROUP BY trial")
def q_toroidal(spark, d):
    return nulls.toroidal_shift(sites(spark, d), TRIALS, 37).groupBy("trial").agg(F.count_if(circle_km("lat", "lon") <= NEAR_KM).alias("n"))


@query("kde_null", f"WITH {SITES}, r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS row, lat, lon, count(*) OVER () AS n, stddev_samp(lat) OVER () AS sa, stddev_samp(lon) OVER () AS so FROM sites), f AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS factor), d AS (SELECT t.range AS trial, r.row, {nulls.draw_int_sql(39, 't.range', 'r.row')} % n AS i FROM r, range({FAST}) t), p AS (SELECT factor, trial, lat + factor * pow(n, -1.0 / 6) * sa * {nulls.normal_sql(41, 'trial', 'd.row')} AS lat, lon + factor * pow(n, -1.0 / 6) * so * {nulls.normal_sql(43, 'trial', 'd.row')} AS lon FROM d JOIN r ON r.row = d.i, f), c AS (SELECT factor, trial, count(*) FILTER (WHERE {circle()} <= {NEAR_KM}) AS n FROM p GROUP BY ALL) SELECT factor, round(avg(n), 5) AS mu, round(stddev_pop(n), 5) AS sigma FROM c GROUP BY factor")
def q_kde_null(spark, d):
    """Mean and deviation of counts near the circle under kernel densities of the sites, at three bandwidths."""
    s = nulls.numbered(sites(spark, d).select("id", "lat", "lon"), ["id"]).select("row", "lat", "lon")
    p = nulls.smoothed_points(s, FAST, s.count(), (0.5, 1.0, 2.0), 39)
    c = p.groupBy("factor", "trial").agg(F.count_if(circle_km("lat", "lon") <= NEAR_KM).alias("n"))
    return c.groupBy("factor").agg(r6(F.avg("n"), 5).alias("mu"), r6(F.stddev_pop("n"), 5).alias("sigma"))


@query("block_bootstrap", f"WITH {SITES}, c AS (SELECT floor(lat / 5) AS a, floor(lon / 5) AS b, count(*) AS n, count(*) FILTER (WHERE {circle()} <= {NEAR_KM}) AS near FROM sites GROUP BY ALL), r AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS row, n, near, count(*) OVER () AS cells FROM c), d AS (SELECT t.range AS trial, {nulls.draw_int_sql(45, 't.range', 'r.row')} % cells AS i FROM r, range({TRIALS}) t) SELECT trial, sum(n)::BIGINT AS n, sum(near)::BIGINT AS near FROM d JOIN r ON r.row = d.i GROUP BY trial")
def q_blocks(spark, d):
    """Cells of 5 degrees drawn with replacement."""
    la, lo = classify.grid_cell("lat", "lon", 5.0)
    c = sites(spark, d).groupBy(la.alias("a"), lo.alias("b")).agg(F.count("*").alias("n"), F.count_if(circle_km("lat", "lon") <= NEAR_KM).alias("near"))
    r = nulls.numbered(c, ["a", "b"])
    return nulls.block_bootstrap(r.select("row", "n", "near"), TRIALS, r.count(), 45)


_MATRIX = f"m AS (SELECT floor({_frame_sql()[0]} / 30)::BIGINT AS seg, floor(bal / 1000)::BIGINT AS bin, count(*)::DOUBLE AS v FROM sites GROUP BY ALL)"


@query("time_shuffle_null", f"WITH {SITES}, {_MATRIX}, t AS (SELECT t.range AS trial, seg, bin, v, row_number() OVER (PARTITION BY t.range, seg ORDER BY bin) AS k, row_number() OVER (PARTITION BY t.range, seg ORDER BY {nulls.draw_int_sql(47, 't.range', '(seg * 1000 + bin + 100)')}, bin) AS h FROM m, range({FAST}) t), p AS (SELECT a.trial, a.seg, a.bin, b.v FROM t a JOIN t b ON b.trial = a.trial AND b.seg = a.seg AND b.h = a.k) SELECT x.trial, round(corr(x.v, y.v), 6) AS r FROM p x JOIN p y ON y.trial = x.trial AND y.seg = x.seg + 1 AND y.bin = x.bin GROUP BY x.trial")
def q_time_shuffle(spark, d):
    """Correlation of neighbouring arcs when the times of each arc are shuffled within it; the matrix is a stated number of arcs and bins."""
    m = sites(spark, d).groupBy(F.floor(geo.arc_position("lat", "lon") / 30).alias("seg"), F.floor(F.col("bal") / 1000).alias("bin")).agg(F.count("*").cast("double").alias("v"))
    t = nulls.trials_of(m, FAST).withColumn("h", nulls.draw_int(47, F.col("trial"), F.col("seg") * 1000 + F.col("bin") + 100))
    w = Window.partitionBy("trial", "seg")
    t = t.withColumns({"k": F.row_number().over(w.orderBy("bin")), "j": F.row_number().over(w.orderBy("h", "bin"))})
    p = t.select("trial", "seg", "bin", "k").join(t.select("trial", "seg", F.col("j").alias("k"), "v"), ["trial", "seg", "k"])
    y = p.select("trial", (F.col("seg") - 1).alias("seg"), "bin", F.col("v").alias("w"))
    return p.join(y, ["trial", "seg", "bin"]).groupBy("trial").agg(r6(F.corr("v", "w")).alias("r"))


# --- ranks in nulls, probabilities ---------------------------------------------------------------------------------------

_POLES = f"""poles AS (SELECT range AS pole_id, degrees(asin(2.0 * {nulls.uniform_sql(5, 'range', '0')} - 1.0)) AS plat, 360.0 * {nulls.uniform_sql(6, 'range', '0')} - 180.0 AS plon FROM range(1000))"""
_DOT = "abs(cos(radians(lat)) * cos(radians(lon)) * cos(radians(plat)) * cos(radians(plon)) + cos(radians(lat)) * sin(radians(lon)) * cos(radians(plat)) * sin(radians(plon)) + sin(radians(lat)) * sin(radians(plat)))"


@query("stratified_percentile", f"WITH {SITES}, {_POLES}, c AS (SELECT cls, pole_id, count(*) FILTER (WHERE {_DOT} <= sin(200 / 6371.0)) AS n FROM sites, poles GROUP BY ALL), o AS (SELECT cls, count(*) FILTER (WHERE {circle()} <= 200) AS obs FROM sites GROUP BY cls) SELECT c.cls, any_value(obs) AS observed, round(100.0 * avg((n < obs)::INT), 5) AS percentile, round(least(1.0, 2.0 * least(avg((n >= obs)::INT), avg((n <= obs)::INT))), 6) AS p FROM c JOIN o ON o.cls = c.cls GROUP BY c.cls")
def q_stratified(spark, d):
    """Strict percentile of the default circle among 1 000 random ones, and its two-tailed p, in each stratum."""
    s = sites(spark, d)
    drawn = nulls.random_poles(spark.range(1000).select(F.col("id").alias("pole_id")), 5).collect()  # as many as were asked for
    c = poles.pole_counts(s, [(r["pole_id"], r["lat"], r["lon"]) for r in drawn], 200.0, "cls")
    o = s.groupBy("cls").agg(F.count_if(circle_km("lat", "lon") <= 200).alias("obs"))
    share = lambda hit: F.sum(hit.cast("int")) / 1000.0
    out = c.join(o, "cls").groupBy("cls").agg(F.max("obs").alias("observed"), share(F.col("n") < F.col("obs")).alias("below"), share(F.col("n") >= F.col("obs")).alias("ge"), share(F.col("n") <= F.col("obs")).alias("le"))
    return out.select("cls", "observed", r6(100.0 * F.col("below"), 5).alias("percentile"), r6(F.least(F.lit(1.0), 2.0 * F.least("ge", "le"))).alias("p"))




@query("pearson_p", f"WITH {SITES}, c AS (SELECT type, corr({circle()}, bal) AS r, count(*)::DOUBLE AS n FROM sites GROUP BY type), t AS (SELECT type, n::BIGINT AS n, r, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS f FROM c), g AS (SELECT type, abs(t) + 60.0 * range / 6000 AS x, f, CASE WHEN range IN (0, 6000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM t, range(6001)), p AS (SELECT type, 2 * sum(0.01 / 3 * w * exp(lgamma((f + 1) / 2.0) - lgamma(f / 2.0)) / sqrt(f * pi()) * pow(1 + x * x / f, -(f + 1) / 2.0)) AS p FROM g GROUP BY type) SELECT t.type, t.n, round(r, 6) AS r, round(p, 5) AS p FROM t JOIN p ON p.type = t.type")
def q_pearson_p(spark, d):
    c = sites(spark, d).withColumn("km", circle_km("lat", "lon")).groupBy("type").agg(F.count("*").alias("n"), stats.pearson("km", "bal").alias("r"))
    return pvalues.with_p(c, "p", pvalues.correlation_p, "r", "n").select("type", "n", r6("r").alias("r"), r6("p", 5).alias("p"))


@query("welch_t", f"WITH {SITES}, m AS (SELECT avg(bal) FILTER (WHERE cls = 'monument') - avg(bal) FILTER (WHERE cls <> 'monument') AS diff, var_samp(bal) FILTER (WHERE cls = 'monument') / count(*) FILTER (WHERE cls = 'monument') AS a, var_samp(bal) FILTER (WHERE cls <> 'monument') / count(*) FILTER (WHERE cls <> 'monument') AS b, count(*) FILTER (WHERE cls = 'monument') AS n1, count(*) FILTER (WHERE cls <> 'monument') AS n2 FROM sites), t AS (SELECT diff / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS f FROM m), g AS (SELECT abs(t) + 60.0 * range / 6000 AS x, f, CASE WHEN range IN (0, 6000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM t, range(6001)), p AS (SELECT 2 * sum(0.01 / 3 * w * exp(lgamma((f + 1) / 2.0) - lgamma(f / 2.0)) / sqrt(f * pi()) * pow(1 + x * x / f, -(f + 1) / 2.0)) AS p FROM g) SELECT round(t, 6) AS t, round(f, 4) AS freedom, round(p, 5) AS p FROM t, p")
def q_welch(spark, d):
    """Difference of two means with unequal variances."""
    x, y = F.when(F.col("cls") == "monument", F.col("bal")), F.when(F.col("cls") != "monument", F.col("bal"))
    m = sites(spark, d).agg((F.avg(x) - F.avg(y)).alias("diff"), (F.var_samp(x) / F.count(x)).alias("a"), (F.var_samp(y) / F.count(y)).alias("b"), F.count(x).alias("n1"), F.count(y).alias("n2"))
    a, b = F.col("a"), F.col("b")
    t = m.select((F.col("diff") / F.sqrt(a + b)).alias("t"), ((a + b) ** 2 / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("freedom"))
    return pvalues.with_p(t, "p", pvalues.student_two_sided, "t", "freedom").select(r6("t").alias("t"), r6("freedom", 4).alias("freedom"), r6("p", 5).alias("p"))


@query("ks_p", f"WITH {SITES}, c AS (SELECT bal, count(*) FILTER (WHERE cls = 'monument') AS x, count(*) FILTER (WHERE cls <> 'monument') AS y FROM sites GROUP BY bal), e AS (SELECT sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x) OVER () AS n1, sum(y) OVER () AS n2 FROM c WINDOW w AS (ORDER BY bal)), d AS (SELECT max(abs(sx / n1 - sy / n2)) AS d, max(n1) AS n1, max(n2) AS n2 FROM e), k AS (SELECT range + 1 AS k FROM range(100)) SELECT round(any_value(d), 6) AS d, round(least(1.0, greatest(0.0, 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * d * d * n1 * n2 / (n1 + n2))))), 5) AS p FROM d, k")
def q_ks_p(spark, d):
    return pvalues.with_p(stats.kolmogorov_smirnov(sites(spark, d), "bal", "cls", "monument"), "p", pvalues.kolmogorov_p, "d", "n1", "n2").select(r6("d").alias("d"), r6("p", 5).alias("p"))


def _granger_sql(y: str, x: str) -> str:
    return f"WITH {_USERDAY}, l AS (SELECT g, {y} AS y0, lag({y}) OVER w AS y1, lag({x}) OVER w AS x1 FROM u WINDOW w AS (PARTITION BY g ORDER BY day)), s AS (SELECT g, count(*) AS n, var_pop(y0) AS c00, var_pop(y1) AS c11, var_pop(x1) AS cxx, covar_pop(y0, y1) AS c01, covar_pop(y0, x1) AS c0x, covar_pop(y1, x1) AS c1x FROM l WHERE y1 IS NOT NULL GROUP BY g), r AS (SELECT g, n, c00 - c01 * c01 / c11 AS r1, c00 - (c01 * cxx - c0x * c1x) / (c11 * cxx - c1x * c1x) * c01 - (c0x * c11 - c01 * c1x) / (c11 * cxx - c1x * c1x) * c0x AS r2 FROM s), f AS (SELECT g, n, (r1 - r2) / (r2 / (n - 3)) AS f, n - 3.0 AS df FROM r), q AS (SELECT f.g, sqrt(f) + 60.0 * range / 6000 AS x, df, CASE WHEN range IN (0, 6000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM f, range(6001)), p AS (SELECT g, 2 * sum(0.01 / 3 * w * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + x * x / df, -(df + 1) / 2.0)) AS p FROM q GROUP BY g) SELECT f.g, round(f, 4) AS f, round(p, 4) AS p FROM f JOIN p ON p.g = f.g"


@query("granger_both", f"SELECT a.g, a.f AS f_forward, a.p AS p_forward, b.f AS f_back, b.p AS p_back FROM ({_granger_sql('y', 'x')}) a JOIN ({_granger_sql('x', 'y')}) b ON a.g = b.g")
def q_granger_both(spark, d):
    """Lag-1 causation in both directions, each with the p of its F."""
    days = _days(spark, d)
    one = lambda x, y, k: pvalues.with_p(stats.granger(days, ["g"], "day", x, y).select("g", "f", F.lit(1.0).alias("a"), (F.col("n") - 3).cast("double").alias("b")), "p", pvalues.fisher_tail, "f", "a", "b").select("g", r6("f", 4).alias(f"f_{k}"), r6("p", 4).alias(f"p_{k}"))
    return one("x", "y", "forward").join(one("y", "x", "back"), "g")


@query("vtest_p", f"WITH {_TURN}, m AS (SELECT type, count(*) AS n, avg(cos(radians(br))) AS c, avg(sin(radians(br))) AS s FROM a GROUP BY type), u AS (SELECT type, sqrt(c * c + s * s) * cos(atan2(s, c) - radians(90.0)) * sqrt(2.0 * n) AS u FROM m), q AS (SELECT type, u + 12.0 * range / 4000 AS x, CASE WHEN range IN (0, 4000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM u, range(4001)) SELECT u.type, round(any_value(u), 6) AS u, round(sum(0.003 / 3 * w * exp(-x * x / 2) / sqrt(2 * pi())), 5) AS p FROM q JOIN u ON u.type = q.type GROUP BY u.type")
def q_vtest_p(spark, d):
    v = circular.circular_summary(_turns(spark, d), ["type"], "br", toward=90.0).select("type", F.col("v_u").alias("u"))
    return pvalues.with_p(v, "p", pvalues.normal_upper, "u").select("type", r6("u").alias("u"), r6("p", 5).alias("p"))


# --- composites ---------------------------------------------------------------------------------------------------------


@query("date_density_anomaly", f"""WITH {_DATES}, b AS (SELECT floor(age / 500) * 500 AS low, count(*) AS n, count(*) FILTER (WHERE {circle()} <= 200) AS near FROM dates WHERE age >= 0 AND age < 20000 GROUP BY 1), a AS (SELECT count(*) FILTER (WHERE {circle()} <= 200)::DOUBLE / count(*) AS share FROM dates WHERE age >= 0 AND age < 20000), e AS (SELECT low, near::DOUBLE / n / share AS e, low >= 10500 AND low < 12500 AS inside FROM b, a WHERE n >= 50)
SELECT count(*) FILTER (WHERE inside) AS bins_inside, count(*) FILTER (WHERE NOT inside) AS bins_outside, round(avg(e) FILTER (WHERE inside), 6) AS inside_mean, round(avg(e) FILTER (WHERE NOT inside), 6) AS outside_mean, round(CASE WHEN stddev_pop(e) FILTER (WHERE NOT inside) > 0 THEN (avg(e) FILTER (WHERE inside) - avg(e) FILTER (WHERE NOT inside)) / stddev_pop(e) FILTER (WHERE NOT inside) ELSE 0 END, 5) AS z FROM e""")
def q_density_anomaly(spark, d):
    """Whether a window of time holds more or fewer dates near the circle than other bins of 500 years, of at least 50 dates each."""
    t = radiocarbon(spark, d).where((F.col("age") >= 0) & (F.col("age") < 20000)).select("age", (circle_km("lat", "lon") <= 200).alias("near"))
    b = t.groupBy((F.floor(F.col("age") / 500) * 500).alias("low")).agg(F.count("*").alias("n"), F.count_if("near").alias("near"))
    one = Window.partitionBy(F.lit(0))  # 40 bins
    share = F.sum("near").over(one) / F.sum("n").over(one)
    e = b.withColumn("e", F.try_divide(F.col("near") / F.col("n"), share)).where("n >= 50").withColumn("inside", (F.col("low") >= 10500) & (F.col("low") < 12500))
    inside, outside = F.when(F.col("inside"), F.col("e")), F.when(~F.col("inside"), F.col("e"))
    z = F.when(F.stddev_pop(outside) > 0, (F.avg(inside) - F.avg(outside)) / F.stddev_pop(outside)).otherwise(0.0)
    return e.agg(F.count(inside).alias("bins_inside"), F.count(outside).alias("bins_outside"), r6(F.avg(inside)).alias("inside_mean"), r6(F.avg(outside)).alias("outside_mean"), r6(z, 5).alias("z"))


@query("unified_timeline", f"""WITH {_DATES}, a AS (SELECT CASE WHEN SiteID IS NULL OR SiteID = '' THEN 'anon_' || lat || '_' || lon ELSE SiteID END AS k, avg(lat) AS lat, avg(lon) AS lon, max(age) AS age FROM dates WHERE age > 0 GROUP BY 1), g AS (SELECT id::VARCHAR AS k, reprLat AS lat, reprLong AS lon, TRY_CAST(minDate AS DOUBLE) AS y FROM pleiades_places_latest WHERE reprLat BETWEEN -90 AND 90 AND reprLong BETWEEN -180 AND 180 AND NOT (reprLat = 0 AND reprLong = 0)),
u AS (SELECT 'dates' AS source, lat, lon, round(1950 - ({_CAL1('age')})) AS bp FROM a UNION ALL SELECT 'gazetteer', lat, lon, round(1950 - y) FROM g WHERE y IS NOT NULL) SELECT source, floor(bp / 1000)::BIGINT AS millennium, floor({bearing('59.682122', '-138.646087', 'lat', 'lon')} / 30)::BIGINT AS arc, count(*) AS n FROM u WHERE {circle()} <= 200 GROUP BY ALL""")
def q_timeline(spark, d):
    """Dated sites and dated places near the circle in one list, by age and arc."""
    known = F.coalesce(F.col("SiteID") != "", F.lit(False))
    key = F.when(known, F.col("SiteID")).otherwise(F.concat_ws("_", F.lit("anon"), F.col("lat").cast("string"), F.col("lon").cast("string")))
    a = radiocarbon(spark, d).where("age > 0").groupBy(key.alias("k")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("age").alias("age"))
    g = table(spark, d, "pleiades_places_latest").select(F.col("reprLat").alias("lat"), F.col("reprLong").alias("lon"), F.expr("try_cast(minDate as double)").alias("y")).where("lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) and y is not null")
    u = a.select(F.lit("dates").alias("source"), "lat", "lon", F.round(1950 - dates.calibrated_year("age")).alias("bp")).unionByName(g.select(F.lit("gazetteer").alias("source"), "lat", "lon", F.round(1950 - F.col("y")).alias("bp")))
    near = u.where(circle_km("lat", "lon") <= 200)
    return near.groupBy("source", F.floor(F.col("bp") / 1000).alias("millennium"), F.floor(geo.pole_bearing("lat", "lon") / 30).alias("arc")).agg(F.count("*").alias("n"))


@query("cluster_synchrony", f"""WITH {SITES}, c AS (SELECT CASE WHEN {hav('lat', 'lon', '-27.1', '-109.3')} < 200 THEN 'Easter Island' WHEN lat BETWEEN 20 AND 36 AND lon BETWEEN 25 AND 40 THEN 'Egypt / Levant' WHEN lat BETWEEN -25 AND 0 AND lon BETWEEN -80 AND -60 THEN 'Peru / Andes' WHEN lat BETWEEN 25 AND 38 AND lon BETWEEN 44 AND 60 THEN 'Iran / Persia' WHEN lat BETWEEN 20 AND 35 AND lon BETWEEN 60 AND 80 THEN 'Indus Valley' WHEN lat BETWEEN 0 AND 25 AND lon BETWEEN 95 AND 115 THEN 'Southeast Asia' END AS c, bal, {_frame_sql()[0]} AS pos FROM sites),
a AS (SELECT c, count(*) AS n, avg(bal) AS m, min(bal) AS lo, max(bal) AS hi, avg(pos) AS pos FROM c WHERE c IS NOT NULL GROUP BY c HAVING count(*) >= 2)
SELECT x.c AS cluster_1, y.c AS cluster_2, x.n AS n_1, y.n AS n_2, round(greatest(0, least(x.hi, y.hi) - greatest(x.lo, y.lo)), 4) AS overlap, round(least(abs(x.pos - y.pos), 360 - abs(x.pos - y.pos)) / 360 * 2 * pi() * 6371.0, 3) AS km, round(abs(x.m - y.m), 4) AS delay FROM a x JOIN a y ON x.c < y.c""")
def q_synchrony(spark, d):
    """Overlap in time, distance along the circle and delay of each two clusters of a stated list."""
    c = sites(spark, d).select(classify.cluster("lat", "lon").alias("c"), "bal", geo.arc_position("lat", "lon").alias("pos")).where("c <> 'Other'")
    a = c.groupBy("c").agg(F.count("*").alias("n"), F.avg("bal").alias("m"), F.min("bal").alias("lo"), F.max("bal").alias("hi"), F.avg("pos").alias("pos")).where("n >= 2").withColumn("k", F.lit(0))
    x, y = (a.select("k", *[F.col(v).alias(f"{v}_{i}") for v in ("c", "n", "m", "lo", "hi", "pos")]) for i in (1, 2))
    p = x.join(y, "k").where("c_1 < c_2")
    apart = F.abs(F.col("pos_1") - F.col("pos_2"))
    return p.select(F.col("c_1").alias("cluster_1"), F.col("c_2").alias("cluster_2"), "n_1", "n_2", r6(F.greatest(F.lit(0.0), F.least("hi_1", "hi_2") - F.greatest("lo_1", "lo_2")), 4).alias("overlap"), r6(F.least(apart, 360 - apart) / 360 * 2 * math.pi * 6371.0, 3).alias("km"), r6(F.abs(F.col("m_1") - F.col("m_2")), 4).alias("delay"))


_RANKED = lambda c: f"rank() OVER (PARTITION BY part ORDER BY {c}) + (count(*) OVER (PARTITION BY part, {c}) - 1) / 2.0"


@query("wavefront", f"WITH {SITES}, s AS (SELECT 'all' AS part, {circle()} AS km, bal FROM sites UNION ALL SELECT 'late', {circle()}, bal FROM sites WHERE bal >= 1000), r AS (SELECT part, km, bal, {_RANKED('km')} AS rk, {_RANKED('bal')} AS rb FROM s) SELECT part, count(*) AS n, round(corr(rk, rb), 6) AS rho, round(corr(km, bal), 6) AS r FROM r GROUP BY part")
def q_wavefront(spark, d):
    """Whether what lies farther from the circle is later: rank and linear correlation, of all and of the late ones."""
    s, out = sites(spark, d).select(circle_km("lat", "lon").alias("km"), "bal"), None
    for part, rows in (("all", s), ("late", s.where("bal >= 1000"))):
        ranked = stats.average_rank(stats.average_rank(rows, "km", "rk"), "bal", "rb")
        one = ranked.agg(F.count("*").alias("n"), r6(F.corr("rk", "rb")).alias("rho"), r6(F.corr("km", "bal")).alias("r")).select(F.lit(part).alias("part"), "n", "rho", "r")
        out = one if out is None else out.unionByName(one)
    return out


@query("golden_gaps", f"WITH t AS (SELECT range AS trial, list_sort([360 * {nulls.uniform_sql(51, 'range', '0')}, 360 * {nulls.uniform_sql(51, 'range', '1')}, 360 * {nulls.uniform_sql(51, 'range', '2')}]) AS p FROM range(10000)), g AS (SELECT trial, [p[2] - p[1], p[3] - p[2], p[1] + 360 - p[3]] AS g FROM t), h AS (SELECT trial, i.range + 1 AS i, j.range + 1 AS j, g FROM g, range(3) i, range(3) j WHERE i.range <> j.range), m AS (SELECT trial, bool_or(abs(g[i] / g[j] - (1 + sqrt(5)) / 2) / ((1 + sqrt(5)) / 2) <= 0.02) AS hit FROM h GROUP BY trial) SELECT count(*) AS trials, round(avg(hit::INT), 6) AS share FROM m")
def q_golden(spark, d):
    """How often two of the three gaps of three random places on a circle stand in the golden ratio, to 2 per cent."""
    u = lambda k: 360.0 * nulls.uniform(51, F.col("id"), F.lit(k))
    p = spark.range(10_000).select(F.sort_array(F.array(u(0), u(1), u(2))).alias("p"))
    a, b, c = (F.col("p")[k] for k in range(3))
    gaps, phi = [b - a, c - b, a + 360.0 - c], (1 + math.sqrt(5)) / 2
    hit = F.greatest(*[(F.abs(x / y - phi) / phi <= 0.02).cast("int") for x in gaps for y in gaps if x is not y])
    return p.agg(F.count("*").alias("trials"), r6(F.avg(hit)).alias("share"))


@query("latitude_belt_share", f"WITH {SITES}, b AS (SELECT floor(lat / 10) * 10 AS belt, count(*) AS n, count(*) FILTER (WHERE {circle()} <= {NEAR_KM}) AS near FROM sites GROUP BY 1) SELECT belt, n, near, round(near::DOUBLE / sum(near) OVER (), 6) AS share, round(n::DOUBLE / sum(n) OVER (), 6) AS expected FROM b")
def q_belts(spark, d):
    b = sites(spark, d).groupBy((F.floor(F.col("lat") / 10) * 10).cast("double").alias("belt")).agg(F.count("*").alias("n"), F.count_if(circle_km("lat", "lon") <= NEAR_KM).alias("near"))
    one = Window.partitionBy(F.lit(0))  # 18 belts
    return b.select("belt", "n", "near", r6(F.col("near") / F.sum("near").over(one)).alias("share"), r6(F.col("n") / F.sum("n").over(one)).alias("expected"))
