"""Queries of joins, ranks, tests, series, directions, dates, rasters and fits over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcspan.functions import classify, dates, geo
from arcspan.functions.geo import circle_km, haversine_km
from arcspan.operators import circular, dedup, fit, joins, raster, stats, windows
from arcspan.plans.reference import _frame_sql, r6, sites, sites2
from arcspan.plans.runtime import table
from arcspan.plans.sqltext import SITES, SITES2, bearing, circle, hav

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# --- joins --------------------------------------------------------------------------------------------------------------


@query("distance_anti_join", f"WITH {SITES}, {SITES2} SELECT id, type FROM sites a WHERE NOT EXISTS (SELECT 1 FROM sites2 b WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500)")
def q_anti(spark, d):
    return joins.without_near(sites(spark, d), sites2(spark, d), "id", "id", 500.0).select("id", "type")


@query("distance_self_density", f"WITH {SITES}, n AS (SELECT a.id, count(*) AS n FROM sites a JOIN sites b ON a.id <> b.id AND abs(a.lat - b.lat) <= 1.8 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200 GROUP BY a.id) SELECT id, coalesce(n, 0) AS neighbours FROM sites LEFT JOIN n USING (id)")
def q_self_density(spark, d):
    s = sites(spark, d)
    n = joins.near_counts(s, s, "id", "id", [200.0], same=False)
    return s.join(n, "id", "left").select("id", F.coalesce("n0", F.lit(0)).alias("neighbours"))


@query("nearest_class", f"WITH {SITES}, p AS (SELECT a.id, b.id AS nearest, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM (SELECT * FROM sites WHERE cls = 'monument') a, (SELECT * FROM sites WHERE cls = 'settlement') b) SELECT id, round(min(km), 6) AS km FROM p GROUP BY id")
def q_nearest_class(spark, d):
    s = sites(spark, d)
    return joins.nearest(s.where("cls = 'monument'"), s.where("cls = 'settlement'"), "id", "id").select("id", r6("km").alias("km"))


@query("two_radii_counts", f"WITH {SITES}, {SITES2}, p AS (SELECT b.id, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM sites a, sites2 b) SELECT id, count(*) FILTER (WHERE km <= 150) AS near, count(*) AS wide FROM p WHERE km <= 500 GROUP BY id")
def q_two_radii(spark, d):
    return joins.near_counts(sites2(spark, d), sites(spark, d), "id", "id", [150.0, 500.0]).where("n1 > 0").select("id", F.col("n0").alias("near"), F.col("n1").alias("wide"))


@query("pair_band_share", f"WITH {SITES}, p AS (SELECT a.type = b.type AS same, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM sites a JOIN sites b ON a.id < b.id AND abs(a.lat - b.lat) <= 2.7) SELECT CAST(floor(km / 100) AS BIGINT) AS band, count(*) AS pairs, round(avg(same::INT), 6) AS share FROM p WHERE km <= 300 GROUP BY 1")
def q_pair_band(spark, d):
    b = joins.pair_bands(sites(spark, d), "id", [0.0, 100.0, 200.0, 300.0], "type")
    return b.select("band", "pairs", r6(F.col("same") / F.col("pairs")).alias("share"))


_SPANS = "spans AS (SELECT o_custkey AS id, min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


@query("interval_bins", f"WITH {_SPANS}, b AS (SELECT 1995 + 2 * range AS bin FROM range(4)) SELECT bin::BIGINT AS bin, count(*) AS active FROM b JOIN spans ON high >= bin AND low <= bin + 2 GROUP BY bin")
def q_interval_bins(spark, d):
    spans = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.year("o_orderdate")).alias("low"), F.max(F.year("o_orderdate")).alias("high"))
    return joins.overlapping_bins(spans, "low", "high", 1995, 2003, 2).groupBy("bin").agg(F.count("*").alias("active"))


_EV = "e AS (SELECT event_id, user_id, event_type, value, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000.0 AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def events(spark, d):
    e = table(spark, d, "events")
    # from parts, so that the session's time zone does not matter to times without one
    seconds = (F.datediff("ts", F.lit("2024-01-01").cast("date")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60).cast("double") + F.extract(F.lit("SECOND"), F.col("ts")).cast("double")
    return e.select("event_id", "user_id", "event_type", "value", seconds.alias("t"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("asof_tolerance", f"WITH {_EV}, p AS (SELECT a.event_id, a.t, b.t AS m, b.event_id AS b, abs(a.t - b.t) AS gap FROM (SELECT * FROM e WHERE event_type = 'error') a JOIN (SELECT * FROM e WHERE event_type = 'click') b ON abs(a.t - b.t) <= 600), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, m, b) AS rn FROM p) SELECT event_id, b AS matched_event, round(gap, 4) AS gap FROM r WHERE rn = 1")
def q_asof(spark, d):
    e = events(spark, d)
    clicks = e.where("event_type = 'click'").select("t", F.col("event_id").alias("matched_event"))
    return joins.asof_tolerance(e.where("event_type = 'error'"), clicks, "event_id", "t", "t", "matched_event", 600.0).select("event_id", "matched_event", r6("gap", 4).alias("gap"))


@query("json_values", f"WITH {_EV} SELECT event_type, count(*) AS n, count(k) AS known, sum(k)::BIGINT AS total, max(k) AS most FROM e GROUP BY 1")
def q_json(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("known"), F.sum("k").alias("total"), F.max("k").alias("most"))


_MONTHS = "m AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS at, count(*) AS n, sum(o_totalprice) / count(*) AS v FROM orders GROUP BY 1)"


def months(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("at")).agg(F.count("*").alias("n"), (F.sum("o_totalprice") / F.count("*")).alias("v"))


@query("lag_corr", f"WITH {_MONTHS}, l AS (SELECT range AS lag FROM range(7)) SELECT lag, count(*) AS pairs, round(corr(a.n::DOUBLE, b.v), 6) AS r FROM l, m a JOIN m b ON b.at = a.at - lag GROUP BY lag")
def q_lag_corr(spark, d):
    m = months(spark, d)
    p = joins.lagged(m, m, "at", "n", "v", list(range(7)))
    return p.groupBy(F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("pairs"), r6(stats.pearson("x", "y")).alias("r"))


# --- ranks, correlation, tests --------------------------------------------------------------------------------------------

_D = f"d AS (SELECT *, {circle()} AS km FROM sites)"
_AVG_RANK = lambda c, t: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{t}"


@query("decile_profile", f"WITH {SITES}, {_D}, q AS (SELECT quantile_cont(bal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM d) SELECT len(list_filter(q, lambda x: x < bal))::BIGINT AS decile, count(*) AS n, round(avg(km), 6) AS mean_km FROM d, q GROUP BY 1")
def q_deciles(spark, d):
    s = sites(spark, d).withColumn("km", circle_km("lat", "lon"))
    edges = s.agg(F.percentile("bal", F.array(*[F.lit(k / 10) for k in range(1, 10)]))).first()[0]
    return s.groupBy(F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x < F.col("bal"))).cast("long").alias("decile")).agg(F.count("*").alias("n"), r6(F.avg("km")).alias("mean_km"))


@query("upper_median", "WITH v AS (SELECT c_mktsegment AS type, c_acctbal AS b, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT type, n, b AS upper_median FROM v WHERE rn = n // 2 + 1")
def q_upper_median(spark, d):
    return windows.upper_median_by(sites(spark, d), ["type"], "bal")


@query("pearson", f"WITH {SITES}, {_D} SELECT type, round(corr(km, bal), 6) AS r, count(*) AS n FROM d GROUP BY type")
def q_pearson(spark, d):
    return sites(spark, d).withColumn("km", circle_km("lat", "lon")).groupBy("type").agg(r6(stats.pearson("km", "bal")).alias("r"), F.count("*").alias("n"))


@query("spearman_avg", f"WITH r AS (SELECT {_AVG_RANK('l_quantity', 'x')}, {_AVG_RANK('l_discount', 'y')} FROM lineitem) SELECT round(corr(rx, ry), 6) AS rho FROM r")
def q_spearman(spark, d):
    return stats.spearman(table(spark, d, "lineitem").select("l_quantity", "l_discount"), "l_quantity", "l_discount").select(r6("rho").alias("rho"))


@query("spearman_ordinal", "WITH r AS (SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS x, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS y FROM supplier) SELECT round(1 - 6 * sum((x - y) * (x - y))::DOUBLE / (count(*) * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM r")
def q_spearman_ordinal(spark, d):
    from arcspan.operators.ranking import rank_within

    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", F.lit(0).alias("k"))
    r = rank_within(rank_within(s, ["k"], ["s_acctbal", "s_suppkey"], ["s_suppkey"], "x"), ["k"], ["s_nationkey", "s_suppkey"], ["s_suppkey"], "y")
    n = F.count("*").cast("double")
    return r.agg(r6(1 - 6 * F.sum((F.col("x") - F.col("y")) ** 2) / (n * (n * n - 1))).alias("rho"))


@query("partial_spearman", f"WITH r AS (SELECT {_AVG_RANK('l_quantity', 'x')}, {_AVG_RANK('l_extendedprice', 'y')}, {_AVG_RANK('l_discount', 'z')} FROM lineitem), c AS (SELECT corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS rho FROM c")
def q_partial(spark, d):
    return stats.partial_spearman(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"), "l_quantity", "l_extendedprice", "l_discount").select(r6("rho").alias("rho"))


@query("ols_residual", f"WITH {SITES}, {_D}, l AS (SELECT regr_slope(bal, km) AS s, regr_intercept(bal, km) AS i FROM d), r AS (SELECT cls, bal - i - s * km AS e FROM d, l) SELECT cls, count(*) AS n, round(avg(e), 5) AS mean_residual, round(stddev_pop(e), 5) AS sd FROM r GROUP BY cls")
def q_ols(spark, d):
    s = stats.residuals(sites(spark, d).withColumn("km", circle_km("lat", "lon")), "km", "bal")
    return s.groupBy("cls").agg(F.count("*").alias("n"), r6(F.avg("residual"), 5).alias("mean_residual"), r6(F.stddev_pop("residual"), 5).alias("sd"))


@query("mann_whitney", f"WITH x AS (SELECT l_quantity AS v, l_returnflag = 'R' AS g FROM lineitem), r AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)), s AS (SELECT sum(r) FILTER (WHERE g) AS r1, count(*) FILTER (WHERE g)::DOUBLE AS n1, count(*) FILTER (WHERE NOT g)::DOUBLE AS n2 FROM r) SELECT r1 - n1 * (n1 + 1) / 2 AS u, n1, n2, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s, t")
def q_mann_whitney(spark, d):
    return stats.mann_whitney(table(spark, d, "lineitem").select("l_quantity", "l_returnflag"), "l_quantity", "l_returnflag", "R").select("u", "n1", "n2", r6("z").alias("z"))


@query("bh_fdr", "WITH p AS (SELECT s_suppkey AS test, ((s_suppkey * 7919) % 9973 + 1) / 9974.0 AS p FROM supplier), k AS (SELECT test, p, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM p) SELECT test, p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC)), 9) AS p_bh FROM k")
def q_bh(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("test"), ((F.pmod(F.col("s_suppkey") * 7919, F.lit(9973)) + 1) / 9974.0).alias("p"))
    return stats.benjamini_hochberg(p, "p").select("test", "p", r6("p_bh", 9).alias("p_bh"))


@query("value_counts", "WITH c AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL) SELECT p_type, p_size, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_size) AS rk FROM c) WHERE rk <= 3")
def q_value_counts(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n"))
    return c.withColumn("rk", F.row_number().over(Window.partitionBy("p_type").orderBy(F.col("n").desc(), "p_size"))).where("rk <= 3").select("p_type", "p_size", "n")


# --- K-functions, series, spectra ---------------------------------------------------------------------------------------

_RADII = [50.0, 100.0, 200.0, 300.0]


@query("ripley_k", f"WITH {SITES}, n AS (SELECT count(*)::DOUBLE AS n FROM sites), p AS (SELECT {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM sites a JOIN sites b ON a.id < b.id AND abs(a.lat - b.lat) <= 2.7), t AS (SELECT unnest({_RADII})::DOUBLE AS radius), c AS (SELECT radius, count(*) FILTER (WHERE km <= radius) AS pairs FROM p, t GROUP BY radius) SELECT radius, pairs, round(510064472.0 / (n * (n - 1)) * (2 * pairs), 4) AS k FROM c, n")
def q_ripley(spark, d):
    s = sites(spark, d)
    n = s.count()
    return stats.ripley(joins.pair_bands(s, "id", [0.0, *_RADII]), _RADII, n, 510064472.0).select("radius", "pairs", r6("k", 4).alias("k"))


_ALONG = f"radians(((({bearing('59.682122', '-138.646087', 'lat', 'lon')} + 180) % 360) - 180)) * 6371.0"


@query("directional_k", f"WITH {SITES}, s AS (SELECT id, {_ALONG} AS along, {hav('lat', 'lon', '59.682122', '-138.646087')} AS perp FROM sites), n AS (SELECT count(*)::DOUBLE AS n FROM s), p AS (SELECT abs(a.along - b.along) AS x, abs(a.perp - b.perp) AS y FROM s a JOIN s b ON a.id < b.id AND abs(a.perp - b.perp) <= 300), t AS (SELECT unnest({_RADII})::DOUBLE AS radius), c AS (SELECT radius, count(*) FILTER (WHERE x > y AND sqrt(x * x + y * y) <= radius) AS par, count(*) FILTER (WHERE x <= y AND sqrt(x * x + y * y) <= radius) AS perp FROM p, t GROUP BY radius) SELECT radius, par AS pairs_parallel, perp AS pairs_across, round(510064472.0 / (n * (n - 1)) * 2 * par, 4) AS k_parallel, round(510064472.0 / (n * (n - 1)) * 2 * perp, 4) AS k_across FROM c, n")
def q_directional(spark, d):
    s = sites(spark, d).select("id", geo.along_pole_km("lat", "lon").alias("along"), haversine_km("lat", "lon", *geo.DEFAULT_POLE).alias("perp"))
    k = stats.directional_k(s, "id", "along", "perp", _RADII, s.count(), 510064472.0)
    return k.select("radius", "pairs_parallel", "pairs_across", r6("k_parallel", 4).alias("k_parallel"), r6("k_across", 4).alias("k_across"))


@query("moran_1d", f"WITH {SITES}, b AS (SELECT type, CAST(floor({_frame_sql()[0]} / 10) AS BIGINT) AS seg, count(*)::DOUBLE AS n FROM sites GROUP BY ALL), d AS (SELECT type, seg, n - avg(n) OVER (PARTITION BY type) AS d FROM b), l AS (SELECT type, d, lead(d) OVER (PARTITION BY type ORDER BY seg) AS e FROM d) SELECT type, count(*) AS n, round(count(*) * sum(d * e) / ((count(*) - 1) * sum(d * d)), 6) AS i FROM l GROUP BY type")
def q_moran(spark, d):
    b = sites(spark, d).groupBy("type", F.floor(geo.arc_position("lat", "lon") / 10).alias("seg")).agg(F.count("*").cast("double").alias("v"))
    return stats.morans_i(b, "seg", "v", ["type"]).select("type", "n", r6("i").alias("i"))


_USERDAY = f"{_EV}, u AS (SELECT event_type AS g, CAST(floor(t / 86400) AS BIGINT) AS day, count(*)::DOUBLE AS x, sum(value) AS y FROM e GROUP BY ALL)"


def _days(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("g"), F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").cast("double").alias("x"), F.sum("value").alias("y"))


@query("acf1", f"WITH {_USERDAY}, l AS (SELECT g, x, lag(x) OVER (PARTITION BY g ORDER BY day) AS p FROM u) SELECT g, round(corr(p, x), 6) AS r, count(p) AS n FROM l GROUP BY g")
def q_acf(spark, d):
    return stats.lag_correlation(_days(spark, d), "day", "x", ["g"]).select("g", r6("r").alias("r"), "n")


@query("granger", f"WITH {_USERDAY}, l AS (SELECT g, y AS y0, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM u WINDOW w AS (PARTITION BY g ORDER BY day)), s AS (SELECT g, count(*) AS n, var_pop(y0) AS c00, var_pop(y1) AS c11, var_pop(x1) AS cxx, covar_pop(y0, y1) AS c01, covar_pop(y0, x1) AS c0x, covar_pop(y1, x1) AS c1x FROM l WHERE y1 IS NOT NULL GROUP BY g), r AS (SELECT g, n, c00 - c01 * c01 / c11 AS r1, c00 - (c01 * cxx - c0x * c1x) / (c11 * cxx - c1x * c1x) * c01 - (c0x * c11 - c01 * c1x) / (c11 * cxx - c1x * c1x) * c0x AS r2 FROM s) SELECT g, n, round((r1 - r2) / (r2 / (n - 3)), 4) AS f FROM r")
def q_granger(spark, d):
    return stats.granger(_days(spark, d), ["g"], "day", "x", "y").select("g", "n", r6("f", 4).alias("f"))


@query("moving_avg", f"WITH {_USERDAY}, m AS (SELECT g, day, avg(x) OVER w AS moving, count(*) OVER w AS c FROM u WINDOW w AS (PARTITION BY g ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT g, day, round(moving, 6) AS moving FROM m WHERE c = 7")
def q_moving(spark, d):
    return windows.moving_average(_days(spark, d), ["g"], "day", "x", 7).select("g", "day", r6("moving").alias("moving"))


@query("local_maxima", f"WITH {_USERDAY}, m AS (SELECT g, day, x, max(x) OVER (PARTITION BY g ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, max(x) OVER (PARTITION BY g ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r FROM u) SELECT g, day, x FROM m WHERE x > coalesce(l, -1e300) AND x > coalesce(r, -1e300)")
def q_maxima(spark, d):
    return windows.local_maxima(_days(spark, d), ["g"], "day", "x", 3).select("g", "day", "x")


@query("dft_power", f"WITH {SITES}, f AS (SELECT range + 1 AS frequency FROM range(12)) SELECT frequency, round(pow(sum(cos(radians({_frame_sql()[0]}) * frequency)), 2) + pow(sum(sin(radians({_frame_sql()[0]}) * frequency)), 2), 3) AS power FROM sites, f GROUP BY frequency")
def q_dft(spark, d):
    return stats.power_at(sites(spark, d).withColumn("arc", geo.arc_position("lat", "lon")), "arc", list(range(1, 13))).select(F.col("frequency").cast("long").alias("frequency"), r6("power", 3).alias("power"))


@query("kde_wrapped", f"WITH {SITES}, b AS (SELECT floor({_frame_sql()[0]} / 0.25) * 0.25 + 0.125 AS c, count(*) AS n FROM sites GROUP BY 1), g AS (SELECT range AS k FROM range(72)) SELECT k * 5.0 AS at, round(sum(n * exp(-0.5 * pow(abs(((k * 5.0 - c + 180.0 + 360.0) % 360) - 180.0) / 4.0, 2)) / (4.0 * sqrt(2 * pi()))), 6) AS density FROM b, g GROUP BY k")
def q_kde(spark, d):
    return stats.wrapped_density(sites(spark, d).withColumn("arc", geo.arc_position("lat", "lon")), "arc", 72, 4.0).select("at", r6("density").alias("density"))


# --- directions ---------------------------------------------------------------------------------------------------------

_TURN = f"{SITES}, a AS (SELECT type, {bearing('lat', 'lon', '29.9792', '31.1342')} AS br FROM sites)"


def _turns(spark, d):
    return sites(spark, d).select("type", geo.bearing("lat", "lon", *geo.GIZA).alias("br"))


@query("bearing_rose", f"WITH {_TURN} SELECT type, floor(br / 30.0) * 30.0 AS bin, count(*) AS n FROM a GROUP BY ALL")
def q_rose(spark, d):
    return circular.rose(_turns(spark, d), ["type"], "br", 30.0)


@query("rose_chi2", f"WITH {_TURN}, b AS (SELECT type, floor(br / 30.0) AS bin, count(*) AS n FROM a GROUP BY ALL) SELECT type, sum(n)::BIGINT AS n, round(sum(n * n) * 12.0 / sum(n) - sum(n), 6) AS chi2 FROM b GROUP BY type")
def q_chi2(spark, d):
    return circular.uniform_chi2(circular.rose(_turns(spark, d), ["type"], "br", 30.0), ["type"], 12).select("type", "n", r6("chi2").alias("chi2"))


def _circ_sql(k: str, half: str) -> str:
    return f"WITH {_TURN}, m AS (SELECT type, count(*) AS n, avg(cos(radians(br) * {k})) AS c, avg(sin(radians(br) * {k})) AS s FROM a GROUP BY type), r AS (SELECT *, sqrt(c * c + s * s) AS r, n * (c * c + s * s) AS z FROM m)"


@query("circular_stats", _circ_sql("1", "1") + " SELECT type, n, round(((degrees(atan2(s, c)) % 360) + 360) % 360, 5) AS mean_deg, round(r, 6) AS r, round(degrees(sqrt(-2 * ln(r))), 5) AS std_deg FROM r")
def q_circ(spark, d):
    return circular.circular_summary(_turns(spark, d), ["type"], "br").select("type", "n", r6("mean_deg", 5).alias("mean_deg"), r6("r").alias("r"), r6("std_deg", 5).alias("std_deg"))


@query("rayleigh", _circ_sql("2", "2") + " SELECT type, round(z, 6) AS z, round(greatest(0.0, least(1.0, exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288.0 * n * n)))), 6) AS p FROM r")
def q_rayleigh(spark, d):
    return circular.circular_summary(_turns(spark, d), ["type"], "br", axial=True).select("type", r6("rayleigh_z").alias("z"), r6("rayleigh_p").alias("p"))


@query("vtest", _circ_sql("1", "1") + " SELECT type, round(r * cos(atan2(s, c) - radians(90.0)), 6) AS v, round(r * cos(atan2(s, c) - radians(90.0)) * sqrt(2.0 * n), 6) AS u FROM r")
def q_vtest(spark, d):
    return circular.circular_summary(_turns(spark, d), ["type"], "br", toward=90.0).select("type", r6("v").alias("v"), r6("v_u").alias("u"))


# --- dates, words, tables -----------------------------------------------------------------------------------------------

CASCADE = [("ring", ["ring", "bolt"]), ("small", ["small", "tiny"]), ("colour", ["red", "blue", "green"])]


@query("keyword_classify", "SELECT CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 'ring' WHEN regexp_matches(lower(p_name), 'small|tiny') THEN 'small' WHEN regexp_matches(lower(p_name), 'red|blue|green') THEN 'colour' ELSE 'other' END AS cls, count(*) AS n FROM part GROUP BY 1")
def q_keyword(spark, d):
    return table(spark, d, "part").groupBy(classify.keyword_class("p_name", CASCADE).alias("cls")).agg(F.count("*").alias("n"))


@query("publication_year", "WITH t AS (SELECT coalesce(Reference, '') AS r, coalesce(Source, '') AS s FROM p3k14c_data), p AS (SELECT coalesce(list_extract(regexp_extract_all(r, '\\((\\d{4})\\)', 1), -1), nullif(regexp_extract(r, '(?:^|[.\\s:])(\\d{4})(?:[.\\s,;:\\-]|$)', 1), ''), list_extract(regexp_extract_all(s, '\\d{4}'), -1)) AS y FROM t) SELECT CAST(y AS INT) AS year, count(*) AS n FROM p GROUP BY 1")
def q_pub_year(spark, d):
    return table(spark, d, "p3k14c_data").groupBy(dates.publication_year("Reference", "Source").alias("year")).agg(F.count("*").alias("n"))


@query("date_parse", "WITH t AS (SELECT minDate AS m FROM pleiades_places_latest), p AS (SELECT m, regexp_extract(m, '^(\\d+)(?:st|nd|rd|th)\\s+c\\s+(BCE|CE)', ['n', 'e']) AS c, regexp_extract(m, '^(\\d+)\\s*(BCE|CE)', ['n', 'e']) AS s, regexp_extract(m, '^(\\d+)\\s*(BCE|CE)?[-–](\\d+)\\s*(BCE|CE)?', ['a', 'e', 'b', 'f']) AS r FROM t), y AS (SELECT CASE WHEN c.n <> '' THEN ((TRY_CAST(c.n AS BIGINT) - 1) * 100 + 50) * CASE WHEN c.e = 'BCE' THEN -1 ELSE 1 END WHEN s.n <> '' THEN TRY_CAST(s.n AS BIGINT) * CASE WHEN s.e = 'BCE' THEN -1 ELSE 1 END WHEN r.b <> '' THEN floor((TRY_CAST(r.a AS BIGINT) * CASE WHEN r.e = 'BCE' OR r.e = '' AND r.f <> '' THEN -1 ELSE 1 END + TRY_CAST(r.b AS BIGINT) * CASE WHEN r.f = 'BCE' THEN -1 ELSE 1 END) / 2)::BIGINT END AS y FROM p) SELECT y AS year, count(*) AS n FROM y GROUP BY y")
def q_date_parse(spark, d):
    return table(spark, d, "pleiades_places_latest").groupBy(dates.parse_date("minDate").alias("year")).agg(F.count("*").alias("n"))


@query("token_count", "SELECT CASE WHEN connectsWith IS NULL OR trim(connectsWith) = '' THEN 0 ELSE len(string_split(connectsWith, ',')) END AS links, count(*) AS n FROM pleiades_places_latest GROUP BY 1")
def q_token_count(spark, d):
    links = F.when(F.coalesce(F.trim("connectsWith"), F.lit("")) == "", 0).otherwise(F.size(F.split("connectsWith", ","))).cast("long")
    return table(spark, d, "pleiades_places_latest").groupBy(links.alias("links")).agg(F.count("*").alias("n"))


@query("cai_unpivot", "WITH b AS (SELECT l_returnflag AS g, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem GROUP BY 1), u AS (SELECT l_linestatus AS s, 'quantity' AS measure, (mq - l_quantity) / sq AS cai FROM lineitem JOIN b ON g = l_returnflag UNION ALL SELECT l_linestatus, 'price', (mp - l_extendedprice) / sp FROM lineitem JOIN b ON g = l_returnflag) SELECT s, measure, count(*) AS n, round(avg(cai), 6) AS cai, round(max(cai), 6) AS top FROM u GROUP BY ALL")
def q_cai(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    long = li.unpivot(["l_linestatus", "l_returnflag"], ["quantity", "price"], "measure", "value")
    base = long.groupBy("l_returnflag", "measure").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    cai = long.join(base, ["l_returnflag", "measure"]).withColumn("cai", (F.col("m") - F.col("value")) / F.col("sd"))
    return cai.groupBy(F.col("l_linestatus").alias("s"), "measure").agg(F.count("*").alias("n"), r6(F.avg("cai")).alias("cai"), r6(F.max("cai")).alias("top"))


@query("zero_filled_matrix", f"WITH {SITES}, g AS (SELECT DISTINCT type FROM sites), b AS (SELECT range * 30 AS seg FROM range(12)), c AS (SELECT type, CAST(floor({_frame_sql()[0]} / 30) * 30 AS BIGINT) AS seg, count(*) AS n FROM sites GROUP BY ALL) SELECT g.type, b.seg, coalesce(n, 0) AS n FROM g CROSS JOIN b LEFT JOIN c ON c.type = g.type AND c.seg = b.seg")
def q_matrix(spark, d):
    s = sites(spark, d).select("type", (F.floor(geo.arc_position("lat", "lon") / 30) * 30).cast("long").alias("seg"))
    bins = spark.range(12).select((F.col("id") * 30).alias("seg"))
    return windows.filled_bins(s, ["type"], "seg", bins, F.count("*")).select("type", F.col("seg").cast("long").alias("seg"), F.col("value").alias("n"))


# --- rasters, fits ------------------------------------------------------------------------------------------------------

_RASTER = "grid AS (SELECT a.range AS row, b.range AS col, ((a.range * 37 + b.range * 91) % 1000) / 10.0 AS value FROM range(37) a, range(72) b)"


def _grid(spark):
    return spark.range(37 * 72).select(F.floor(F.col("id") / 72).cast("int").alias("row"), F.pmod("id", F.lit(72)).cast("int").alias("col")).withColumn("value", F.pmod(F.col("row") * 37 + F.col("col") * 91, F.lit(1000)) / 10.0)


_CELL = lambda r, c: f"((({r})::BIGINT * 37 + ({c})::BIGINT * 91) % 1000) / 10.0"


@query("bilinear_sample", f"WITH {SITES}, p AS (SELECT id, (90.0 - lat) / 5.0 AS y, (lon + 180.0) / 5.0 AS x, least(floor((90.0 - lat) / 5.0), 35) AS t FROM sites), f AS (SELECT id, t, floor(x)::BIGINT % 72 AS l, (floor(x)::BIGINT + 1) % 72 AS r, y - t AS fy, x - floor(x) AS fx FROM p) SELECT id, round((1 - fy) * ((1 - fx) * {_CELL('t', 'l')} + fx * {_CELL('t', 'r')}) + fy * ((1 - fx) * {_CELL('t + 1', 'l')} + fx * {_CELL('t + 1', 'r')}), 6) AS value FROM f")
def q_bilinear(spark, d):
    return raster.bilinear(sites(spark, d), _grid(spark), 5.0, "id").select("id", r6("value").alias("value"))


@query("raster_gradient", f"WITH {_RASTER}, v AS (SELECT *, lag(value) OVER c + 2 * value + lead(value) OVER c AS smooth, lead(value) OVER c - lag(value) OVER c AS diff FROM grid WINDOW c AS (PARTITION BY col ORDER BY row)), h AS (SELECT row, col, lead(smooth) OVER r - lag(smooth) OVER r AS gx, lag(diff) OVER r + 2 * diff + lead(diff) OVER r AS gy FROM v WINDOW r AS (PARTITION BY row ORDER BY col)) SELECT row::INT AS row, col::INT AS col, round(sqrt(gx * gx + gy * gy), 6) AS slope FROM h WHERE gx IS NOT NULL AND gy IS NOT NULL")
def q_gradient(spark, d):
    return raster.gradient(_grid(spark)).select("row", "col", r6("slope").alias("slope"))


@query("svd_pole_fit")
def q_svd(spark, d):
    f = fit.fit_pole(sites(spark, d), ["type"])
    return f.select("type", "n", r6("pole_lat", 4).alias("pole_lat"), r6("pole_lon", 4).alias("pole_lon"), r6("rms_km", 3).alias("rms_km"))


@query("procrustes", f"WITH {SITES}, m AS (SELECT type, count(*) AS n, var_pop(lat) + var_pop(lon) AS va, var_pop(bal) + var_pop(id) AS vb, covar_pop(lat, bal) AS a, covar_pop(lat, id) AS b, covar_pop(lon, bal) AS c, covar_pop(lon, id) AS d FROM sites GROUP BY type) SELECT type, n, round(1 - (a * a + b * b + c * c + d * d + 2 * abs(a * d - b * c)) / (va * vb), 6) AS disparity FROM m")
def q_procrustes(spark, d):
    return fit.procrustes(sites(spark, d), "lat", "lon", "bal", "id", ["type"]).select("type", "n", r6("disparity").alias("disparity"))


@query("long_axis", f"WITH {SITES}, m AS (SELECT nation, count(*) AS n, cos(radians(avg(lat))) AS k, var_pop(lon) AS vx, var_pop(lat) AS vy, covar_pop(lon, lat) AS vxy FROM sites GROUP BY nation) SELECT nation, n, round(((degrees(0.5 * atan2(2 * vxy * k, vy - vx * k * k)) % 180) + 180) % 180, 5) AS bearing_deg FROM m WHERE n > 2")
def q_long_axis(spark, d):
    return fit.long_axis(sites(spark, d), ["nation"], "lat", "lon").where("n > 2").select("nation", "n", r6("bearing_deg", 5).alias("bearing_deg"))


@query("greedy_radius")
def q_greedy(spark, d):
    return dedup.greedy_radius(sites(spark, d), "id", "nation", 100.0).select("id", "nation")


@query("ordered_fold")
def q_fold(spark, d):
    s = sites(spark, d).withColumn("age", F.col("bal") / 10.0)
    return dedup.ordered_fold(s, "lat", "lon", "age", 0.5, 400.0).select("id")
