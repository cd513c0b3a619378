import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arcspan.operators import circular, dedup, fit, joins, nulls, poles, raster, stats, windows
from arcspan.operators.ranking import rank_within
from arcspan.operators.spatial import haversine_np


def points(spark, n, seed, extra=""):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)))], "id long, lat double, lon double")


def test_rank_within(spark):
    rows = [(k, v, i) for i, (k, v) in enumerate([("a", 1), ("a", 1), ("a", 2), (None, 5), (None, None), ("b", 3)] * 5)]
    df = spark.createDataFrame(rows, "k string, v int, id long")
    got = rank_within(df, ["k"], ["v"], ["id"]).toPandas()
    for k, part in got.groupby("k", dropna=False):
        assert sorted(part["rank"]) == list(range(len(part)))
        assert part.sort_values("rank")["v"].fillna(-1).is_monotonic_increasing
    assert rank_within(df.limit(0), ["k"], ["v"], ["id"]).count() == 0


def test_rank_of_values_that_are_all_different(spark):
    """One key, an order without ties: the ranks are right and no task holds all rows of the key."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.pmod(F.col("id") * 7919, F.lit(20_011)).alias("v"), "id")
    ranked = rank_within(df, ["k"], ["v"], ["id"])
    got = ranked.toPandas().sort_values("v")
    assert got["rank"].tolist() == list(range(20_000))
    assert ranked.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 15_000


def test_counts_near_against_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(o), float(v), "xy"[i % 2]) for i, (a, o, v) in enumerate(zip(rng.normal(10, 2, 300), rng.normal(179, 3, 300), rng.normal(0, 1, 300)))] + [(1000, None, 3.0, 1.0, "x"), (None, 10.0, 179.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, v double, c string")
    km = lambda p, q: float(haversine_np(p[1], p[2], q[1], q[2]))
    good = [r for r in rows if r[1] is not None]
    got = {r["id"]: (r["n0"], r["n1"]) for r in joins.near_counts(df, df, "id", "id", [50.0, 200.0], same=False).collect()}
    for p in good:
        far = [km(p, q) for q in good if q[0] is not None and q[0] != p[0]]
        want = (sum(x <= 50 for x in far), sum(x <= 200 for x in far))
        assert got.get(p[0], (0, 0)) == want
    pairs = [(km(p, q), p[4] == q[4]) for k, p in enumerate(good[:300]) for q in good[k + 1 : 300]]
    bands = {r["band"]: (r["pairs"], r["same"]) for r in joins.pair_bands(df, "id", [0.0, 50.0, 200.0], "c").collect()}
    assert bands == {0: (sum(x < 50 for x, _ in pairs), sum(x < 50 and y for x, y in pairs)), 1: (sum(50 <= x <= 200 for x, _ in pairs), sum(50 <= x <= 200 and y for x, y in pairs))}
    few = df.where("id < 20")
    near = {r["id"]: r["near"] for r in joins.with_near(df, few, "id", "id", 100.0).collect()}
    assert near == {p[0]: min(q[0] for q in good[:20] if km(p, q) <= 100) for p in good if any(km(p, q) <= 100 for q in good[:20])}
    assert joins.without_near(df, few, "id", "id", 0.0, strict=True).count() == len(rows) and joins.without_near(df.where("id < 20"), few, "id", "id", 0.0).count() == 0
    assert joins.near_counts(df.limit(0), df, "id", "id", [5.0]).count() == joins.with_near(df, df.limit(0), "id", "id", 5.0).count() == 0


def test_prefixes(spark):
    left = spark.createDataFrame([(1, "Tomb 5"), (2, "Tom"), (3, None), (4, ""), (5, "x" * 3000 + "y")], "id long, name string")
    bases = spark.createDataFrame([("Tomb",), ("Tom",), ("T",), (None,), ("",), ("x" * 3000,), ("Tomb",)], "base string")
    got = sorted((r["id"], len(r["base"])) for r in joins.prefix_matches(left, bases, "name", "base").collect())
    assert got == [(1, 1), (1, 3), (1, 4), (2, 1), (2, 3), (5, 3000)]


def test_nearest_is_exact(spark):
    a, b = points(spark, 120, 1), points(spark, 25, 2)
    pa, pb = a.toPandas(), b.toPandas()
    d = haversine_np(pa["lat"].to_numpy()[:, None], pa["lon"].to_numpy()[:, None], pb["lat"].to_numpy(), pb["lon"].to_numpy())
    got = joins.nearest(a, b, "id", "id").toPandas().sort_values("id")
    assert np.allclose(got["km"], d.min(1)) and (got["nearest"].to_numpy() == d.argmin(1)).all()
    assert joins.nearest(a, b.limit(0), "id", "id").count() == 0
    assert joins.without_near(a, b, "id", "id", 1500.0).count() == int((d.min(1) > 1500.0).sum())


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 99.0), (4, None)], "id long, t double")
    right = spark.createDataFrame([(8.0, 5), (12.0, 6), (20.0, 9), (20.0, 7), (None, 1)], "at double, v int")
    got = {r["id"]: (r["matched"], r["v"]) for r in joins.asof_tolerance(left, right, "id", "t", "at", "v", 5.0).collect()}
    assert got == {1: (8.0, 5), 2: (20.0, 7)}


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 3, 9), (2, 10, 10), (3, 30, 40), (4, 9, 3), (5, None, 4)], "id long, a int, b int")
    got = sorted((r["id"], r["bin"]) for r in joins.overlapping_bins(spans, "a", "b", 0, 20, 5).collect())
    assert got == sorted((i, t) for i, a, b in ((1, 3, 9), (2, 10, 10)) for t in (0, 5, 10, 15) if b >= t and a <= t + 5)


def test_pole_counts_match_definition(spark):
    s = points(spark, 300, 4).withColumn("cls", F.when(F.col("id") % 3 == 0, "a"))
    got = {(r["pole_id"], r["cls"]): r["n"] for r in poles.pole_counts(s, poles.pole_grid(45.0), 500.0, "cls").collect()}
    p = s.toPandas()
    for pole_id, la, lo in poles.pole_grid(45.0):
        near = np.abs(haversine_np(p["lat"], p["lon"], la, lo) - math.pi * 6371.0 / 2) <= 500.0
        assert got[(pole_id, "a")] == int((near & (p["cls"] == "a")).sum())
        assert got[(pole_id, None)] == int((near & p["cls"].isna()).sum())
    assert poles.pole_counts(s.limit(0), poles.pole_grid(45.0), 500.0).count() == 0


def test_uniform_poles_hit_the_zone_share(spark):
    s = points(spark, 2000, 5)
    drawn = [(r["pole_id"], r["lat"], r["lon"]) for r in nulls.random_poles(spark.range(400).withColumnRenamed("id", "pole_id")).collect()]
    n = np.array([r["n"] for r in poles.pole_counts(s, drawn, 300.0).collect()])
    share = math.sin(300.0 / 6371.0)
    assert abs(n.mean() / 2000 - share) < 4 * n.std() / 2000 / math.sqrt(len(n)) + 2e-3


def test_draws_do_not_depend_on_partitions(spark):
    s = points(spark, 50, 6).select(F.col("id").alias("row"), "lat", "lon")
    a = nulls.matched_points(s, 3, 50).orderBy("trial", "row").toPandas()
    b = nulls.matched_points(s.repartition(3), 3, 50).orderBy("trial", "row").toPandas()
    assert np.allclose(a[["lat", "lon"]], b[["lat", "lon"]]) and len(a) == 150
    u = spark.range(20_000).select(nulls.uniform(1, F.lit(0), F.col("id")).alias("u"), nulls.normal(3, F.lit(0), F.col("id")).alias("z")).agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(u[0] - 0.5) < 0.02 and 0 < u[1] and u[2] < 1 and abs(u[3]) < 0.05 and abs(u[4] - 1) < 0.05


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drawn_slots_are_not_broadcast(spark):
    """Trials that are still to be exploded look as small as the sites; broadcast, they overran the driver."""
    s = spark.range(50).select(F.col("id").alias("row"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    assert "BroadcastHashJoin" not in plan(nulls.matched_points(s, 30, 50, clamp=False, seed=55))
    assert plan(nulls.matched_points(s, 30, 50, joint=False)).count("SortMergeJoin") == 2


def test_smoothed_points_meet_the_sites_once(spark):
    s = spark.range(50).select(F.col("id").alias("row"), F.col("id").cast("double").alias("lat"), F.lit(2.0).alias("lon"))
    p = nulls.smoothed_points(s, 30, 50, (0.5, 2.0), 39)
    assert "BroadcastHashJoin" not in plan(p) and plan(p).count("SortMergeJoin") == 1
    assert {r["factor"]: r["count"] for r in p.groupBy("factor").count().collect()} == {0.5: 1500, 2.0: 1500}
    assert nulls.smoothed_points(s.limit(0), 30, 0).count() == 0


def test_numbered_is_dense(spark):
    got = nulls.numbered(spark.range(5, 105, 3).repartition(5), ["id"]).toPandas()
    assert sorted(got["row"]) == list(range(len(got)))


def test_null_summary_counts_missing_trials(spark):
    observed = spark.createDataFrame([(1, 3), (2, 0)], "km int, n long")
    null = spark.createDataFrame([(0, 1, 4), (1, 1, 2)], "trial long, km int, n long")
    got = {r["km"]: r for r in nulls.null_summary(observed, null, ["km"], 4).collect()}
    assert got[1]["mu"] == 1.5 and got[1]["p"] == 0.25 and got[1]["z"] == pytest.approx(1.5 / np.std([4, 2, 0, 0]))
    assert got[2]["z"] == 0.0 and got[2]["enrichment"] is None and got[2]["p"] == 1.0


def test_ranks_and_tests_against_pandas(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"x": rng.integers(0, 12, 400).astype(float), "y": rng.integers(0, 9, 400).astype(float), "g": rng.choice(["a", "b"], 400)})
    df = spark.createDataFrame(pdf)
    r = stats.average_rank(df, "x", "r").toPandas()
    assert np.allclose(sorted(r["r"]), sorted(pdf["x"].rank()))
    assert stats.spearman(df, "x", "y").first()[0] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))
    ranks = pdf["x"].rank()
    u = ranks[pdf["g"] == "a"].sum() - (pdf["g"] == "a").sum() * ((pdf["g"] == "a").sum() + 1) / 2
    assert stats.mann_whitney(df, "x", "g", "a").first()["u"] == pytest.approx(u)
    z = spark.range(1).select(stats.normal_tail(F.lit(1.959964)).alias("a"), stats.normal_tail(F.lit(-1.0)).alias("b")).first()
    assert z["a"] == pytest.approx(0.025, abs=1e-6) and z["b"] == pytest.approx(0.8413447, abs=1e-6)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5, None]
    got = {r["p"]: r["p_bh"] for r in stats.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()}
    assert got == {0.01: pytest.approx(0.04), 0.03: pytest.approx(0.04 * 4 / 3), 0.04: pytest.approx(0.04 * 4 / 3), 0.5: pytest.approx(0.5)}


def test_islands_wrap(spark):
    df = spark.createDataFrame([("a", k) for k in (0, 1, 5, 6, 9)] + [("b", k) for k in range(10)] + [("c", 9)], "g string, k long")
    got = {(r["g"], r["first"], r["last"], r["size"]) for r in windows.islands(df, ["g"], "k", 10).collect()}
    assert got == {("a", 9, 1, 3), ("a", 5, 6, 2), ("b", 0, 9, 10), ("c", 9, 9, 1)}


def test_circular(spark):
    df = spark.createDataFrame([("e", 10.0), ("e", 350.0), ("x", 0.0), ("x", 180.0), ("x", None)], "g string, a double")
    got = {r["g"]: r for r in circular.circular_summary(df, ["g"], "a").collect()}
    assert got["e"]["mean_deg"] % 360 == pytest.approx(0, abs=1e-6) or got["e"]["mean_deg"] == pytest.approx(360)
    assert got["x"]["r"] == pytest.approx(0, abs=1e-9) and got["x"]["n"] == 2
    axial = {r["g"]: r for r in circular.circular_summary(df, ["g"], "a", axial=True).collect()}
    assert axial["x"]["r"] == pytest.approx(1)


@pytest.mark.parametrize("km", [300.0, 1500.0])
def test_greedy_radius_against_loop(spark, km):
    s = points(spark, 80, 9).withColumn("rank", F.col("id") % 7)
    hot = spark.createDataFrame([(1000 + i, 10.0 + i * 1e-5, 20.0, 3) for i in range(60)] + [(2000, 89.9, 0.0, 1), (2001, 89.9, 180.0, 2), (2002, -45.0, 179.99, 1), (2003, -45.0, -179.99, 2), (2004, None, 1.0, 1)], "id long, lat double, lon double, rank long")
    s = s.unionByName(hot)
    kept = []
    for r in s.where("lat is not null").toPandas().sort_values(["rank", "id"]).itertuples():
        if all(haversine_np(r.lat, r.lon, q.lat, q.lon) > km for q in kept):
            kept.append(r)
    assert {r["id"] for r in dedup.greedy_radius(s, "id", "rank", km).collect()} == {q.id for q in kept} | {2004}
    assert dedup.greedy_radius(s.limit(0), "id", "rank", km).count() == 0


def test_sources_in_order_of_priority(spark):
    rows = [(1, "a", 0, 10.0, 10.0), (2, "a", 0, 10.0, 10.001), (3, "b", 1, 10.0, 10.0005), (4, "b", 1, 12.0, 10.0), (5, "c", 2, 12.0, 10.001), (6, None, 3, 50.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, src string, p int, lat double, lon double")
    assert {r["id"] for r in dedup.without_other_source(df, "id", "p", "src", 2.0).collect()} == {1, 2, 4, 6}


@pytest.mark.parametrize("seed, span, ages", [(11, 50, 800), (12, 2000, 3000), (13, 8, 100), (14, 300, 20000)])
def test_ordered_fold_against_loop(spark, seed, span, ages):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.integers(0, span)) / 1000 + 0.0002, float(rng.integers(0, 50)) / 1000 + 0.0002, float(rng.integers(0, ages))) for i in range(150)]
    rows += rows[:5] + [(900, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, age double")
    got = {tuple(r)[1:] for r in dedup.ordered_fold(df, "lat", "lon", "age").collect()}
    last, kept = None, []
    for _, a, o, t in sorted([r for r in rows if r[1] is not None], key=lambda r: (round(r[1], 2), round(r[2], 2), r[3], r[1], r[2])):
        if last is None or not (abs(a - last[0]) < 0.01 and abs(o - last[1]) < 0.01 and abs(t - last[2]) < 200):
            last = (a, o, t)
            kept.append(last)
    assert got == set(kept) and len(got) == len(kept)
    assert dedup.ordered_fold(df.limit(0), "lat", "lon", "age").count() == 0


def test_fit_pole_finds_the_circle(spark):
    from arcspan.functions import geo

    trace = spark.range(0, 360, 7).select(F.lit("t").alias("g"), geo.point_lat(F.col("id")).alias("lat"), geo.point_lon(F.col("id")).alias("lon"))
    r = fit.fit_pole(trace, ["g"]).first()
    assert r["pole_lat"] == pytest.approx(geo.DEFAULT_POLE[0], abs=1e-6) and r["pole_lon"] == pytest.approx(geo.DEFAULT_POLE[1], abs=1e-6) and r["rms_km"] < 1e-3


def test_bilinear_is_exact_on_planes(spark):
    grid = spark.range(37 * 72).select((F.col("id") / 72).cast("int").alias("row"), (F.col("id") % 72).cast("int").alias("col")).withColumn("value", F.col("row") * 2.0)
    p = spark.createDataFrame([(1, 90.0, 0.0), (2, 12.5, 179.0), (3, -90.0, -180.0)], "id long, lat double, lon double")
    got = {r["id"]: r["value"] for r in raster.bilinear(p, grid, 5.0, "id").collect()}
    assert got == {1: pytest.approx(0.0), 2: pytest.approx((90 - 12.5) / 5 * 2), 3: pytest.approx(72.0)}
