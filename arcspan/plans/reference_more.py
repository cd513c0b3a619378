"""Queries of classes, lookups, nulls, tests and composite analyses that the other modules leave."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from arcspan.functions import classify, dates, geo
from arcspan.functions.geo import band_sine, circle_km, haversine_km
from arcspan.operators import joins, nulls, poles, stats, windows
from arcspan.plans.reference import _DOT, _POLES, _frame_sql, gazetteer, r6, sites, sites2
from arcspan.plans.reference_stats import _EV, _MONTHS, events, months
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


_D = f"d AS (SELECT *, {circle()} AS km FROM sites)"
_TYPES = "g AS (SELECT list_transform(string_split(lower(featureTypes), ','), lambda x: trim(x)) AS t FROM pleiades_places_latest WHERE reprLat BETWEEN -90 AND 90 AND reprLong BETWEEN -180 AND 180 AND NOT (reprLat = 0 AND reprLong = 0))"
_L = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
LABELS = classify.USES


# --- classes --------------------------------------------------------------------------------------------------------------


@query("multi_label_classes", f"WITH {_TYPES}, l AS (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN list_has_any(t, {_L(w)}) THEN '{k}' END" for k, w in LABELS) + "], lambda x: x IS NOT NULL)) AS label FROM g) SELECT label, count(*) AS n FROM l GROUP BY label")
def q_multi_label(spark, d):
    return gazetteer(spark, d).select(F.explode(classify.multi_label(F.col("types"), LABELS)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("overlapping_classes", f"WITH {_TYPES} SELECT list_has_any(t, {_L(classify.MONUMENTAL)}) AS monument, list_has_any(t, {_L(classify.SETTLEMENT)}) AS settlement, count(*) AS n FROM g GROUP BY ALL")
def q_flags(spark, d):
    m, s = classify.flags(F.col("types"))
    return gazetteer(spark, d).groupBy(m.alias("monument"), s.alias("settlement")).agg(F.count("*").alias("n"))


PERIODS = [("old", None, 1996), ("middle", 1996, 1999), ("late", 1999, None)]


@query("period_lookup", "SELECT CASE WHEN year(o_orderdate) < 1996 THEN 'old' WHEN year(o_orderdate) >= 1996 AND year(o_orderdate) < 1999 THEN 'middle' ELSE 'late' END AS period, count(*) AS n, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last FROM orders GROUP BY 1")
def q_period(spark, d):
    y = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"))
    return y.groupBy(classify.period("y", PERIODS).alias("period")).agg(F.count("*").alias("n"), F.min("y").alias("first"), F.max("y").alias("last"))


@query("cluster_assign", f"""WITH {SITES} SELECT CASE WHEN {hav('lat', 'lon', '-27.1', '-109.3')} < 200 THEN 'Easter Island' WHEN lat >= 20 AND lat <= 36 AND lon >= 25 AND lon <= 40 THEN 'Egypt / Levant' WHEN lat >= -25 AND lat <= 0 AND lon >= -80 AND lon <= -60 THEN 'Peru / Andes' WHEN lat >= 25 AND lat <= 38 AND lon >= 44 AND lon <= 60 THEN 'Iran / Persia' WHEN lat >= 20 AND lat <= 35 AND lon >= 60 AND lon <= 80 THEN 'Indus Valley' WHEN lat >= 0 AND lat <= 25 AND lon >= 95 AND lon <= 115 THEN 'Southeast Asia' ELSE 'Other' END AS cluster, count(*) AS n FROM sites GROUP BY 1""")
def q_cluster(spark, d):
    return sites(spark, d).groupBy(classify.cluster("lat", "lon").alias("cluster")).agg(F.count("*").alias("n"))


@query("longitude_offsets", f"WITH {SITES} SELECT floor((((lon - 31.1342) % 360 + 360) % 360) / 15.0) * 15.0 AS bin, count(*) AS n FROM sites GROUP BY 1")
def q_offsets(spark, d):
    return sites(spark, d).groupBy(classify.offset_bin("lon", 31.1342, 15.0).alias("bin")).agg(F.count("*").alias("n"))


@query("half_open_strips", f"WITH {SITES} SELECT CASE WHEN lon >= -180 AND lon < -60 THEN 'west' WHEN lon >= -60 AND lon < 60 THEN 'middle' ELSE 'east' END AS strip, lat >= 0 AS north, count(*) AS n, count(*) FILTER (WHERE {circle()} <= 200) AS near FROM sites GROUP BY ALL")
def q_strips(spark, d):
    lon = F.col("lon")
    strip = F.when((lon >= -180) & (lon < -60), "west").when((lon >= -60) & (lon < 60), "middle").otherwise("east")
    return sites(spark, d).groupBy(strip.alias("strip"), (F.col("lat") >= 0).alias("north")).agg(F.count("*").alias("n"), F.count_if(circle_km("lat", "lon") <= 200).alias("near"))


@query("verdicts", f"WITH {SITES}, {_D}, c AS (SELECT type, count(*) AS n, count(*) FILTER (WHERE km <= 200) AS o FROM d GROUP BY type), z AS (SELECT type, (o - n * sin(200 / 6371.0)) / sqrt(n * sin(200 / 6371.0)) AS z FROM c) SELECT type, CASE WHEN z >= 2 THEN 'enriched' WHEN z <= -2 THEN 'depleted' ELSE 'as expected' END AS verdict, round(z, 6) AS z FROM z")
def q_verdicts(spark, d):
    c = sites(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if(circle_km("lat", "lon") <= 200).alias("o"))
    e = F.col("n") * math.sin(200 / 6371.0)
    z = c.withColumn("z", (F.col("o") - e) / F.sqrt(e))
    return z.select("type", F.when(F.col("z") >= 2, "enriched").when(F.col("z") <= -2, "depleted").otherwise("as expected").alias("verdict"), r6("z").alias("z"))


# --- joins ----------------------------------------------------------------------------------------------------------------


@query("prefix_join", "WITH b AS (SELECT n_nationkey AS k, n_name AS base FROM nation), c AS (SELECT c_custkey, c_nationkey, n_name || '-' || (c_custkey % 7) AS full_name FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT b.base, count(*) AS n FROM c JOIN b ON starts_with(c.full_name, b.base) GROUP BY b.base")
def q_prefix(spark, d):
    nation = table(spark, d, "nation")
    full = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat("n_name", F.lit("-"), F.pmod("c_custkey", F.lit(7)).cast("string")).alias("full_name"))
    return joins.prefix_matches(full, nation.select("n_name"), "full_name", "n_name").groupBy(F.col("n_name").alias("base")).agg(F.count("*").alias("n"))


@query("column_check", "WITH w AS (SELECT unnest(['BUILDING', 'FURNITURE', 'BRIDGES', 'TOMBS']) AS code), h AS (SELECT DISTINCT c_mktsegment AS code FROM customer) SELECT w.code, w.code IN (SELECT code FROM h) AS found FROM w")
def q_columns(spark, d):
    wanted = spark.createDataFrame([(x,) for x in ("BUILDING", "FURNITURE", "BRIDGES", "TOMBS")], "code string")
    have = table(spark, d, "customer").select(F.col("c_mktsegment").alias("code")).distinct()
    found = wanted.join(have, "code", "left_semi").withColumn("found", F.lit(True))
    return found.unionByName(wanted.join(have, "code", "left_anti").withColumn("found", F.lit(False)))


@query("series_match", f"WITH {_MONTHS}, q AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS at, count(*) AS shipped FROM lineitem GROUP BY 1) SELECT m.at, n AS ordered, shipped FROM m JOIN q ON q.at = m.at")
def q_series(spark, d):
    shipped = table(spark, d, "lineitem").groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("at")).agg(F.count("*").alias("shipped"))
    return months(spark, d).join(shipped, "at").select("at", F.col("n").alias("ordered"), "shipped")


@query("pair_108", f"WITH {SITES}, u AS (SELECT id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM sites) SELECT a.id AS centre_id, count(*) FILTER (WHERE a.x * b.x + a.y * b.y + a.z * b.z BETWEEN {math.cos(math.radians(108.5))!r} AND {math.cos(math.radians(107.5))!r}) AS n FROM u a, u b WHERE a.id % 50 = 0 GROUP BY a.id")
def q_108(spark, d):
    """Sites at an angle of 108 degrees, half a degree either way, from every site whose id is divisible by 50."""
    s = sites(spark, d)
    centres = [(r["id"], r["lat"], r["lon"]) for r in s.where(F.col("id") % 50 == 0).select("id", "lat", "lon").limit(poles.MAX_POLES + 1).collect()]
    return poles.ring_counts(s, centres, 107.5, 108.5)


@query("routes", f"WITH {SITES}, p AS (SELECT o_orderkey AS k, any_value(s_suppkey) AS s FROM (SELECT l_orderkey AS o_orderkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY 1) GROUP BY 1), {SITES2}, r AS (SELECT DISTINCT o_custkey AS c, p.s FROM orders JOIN p ON p.k = o_orderkey) SELECT c, s, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km FROM r JOIN sites a ON a.id = c JOIN sites2 b ON b.id = s WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} >= 10 AND (floor(a.lat) <> floor(b.lat) OR floor(a.lon) <> floor(b.lon))")
def q_routes(spark, d):
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s"))
    pairs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c")).join(first, "o_orderkey").select("c", "s").distinct()
    a, b = sites(spark, d).select(F.col("id").alias("c"), F.col("lat").alias("la"), F.col("lon").alias("lo")), sites2(spark, d).select(F.col("id").alias("s"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    r = pairs.join(a, "c").join(b, "s").withColumn("km", haversine_km("la", "lo", "lb", "ob"))
    return r.where((F.col("km") >= 10) & ((F.floor("la") != F.floor("lb")) | (F.floor("lo") != F.floor("ob")))).select("c", "s", r6("km").alias("km"))


@query("trajectory", f"WITH {SITES}, t AS (SELECT nation, id, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(id) OVER w - id AS step FROM sites WINDOW w AS (PARTITION BY nation ORDER BY id)) SELECT nation, id, step, round({hav('lat', 'lon', 'lat2', 'lon2')}, 6) AS km, round({bearing('lat', 'lon', 'lat2', 'lon2')}, 5) AS course FROM t WHERE lat2 IS NOT NULL")
def q_trajectory(spark, d):
    t = joins.consecutive(sites(spark, d).select("nation", "id", "lat", "lon"), ["nation"], ["id"], ["lat", "lon", "id"])
    return t.select("nation", "id", (F.col("next_id") - F.col("id")).alias("step"), r6(haversine_km("lat", "lon", "next_lat", "next_lon")).alias("km"), r6(geo.bearing("lat", "lon", "next_lat", "next_lon"), 5).alias("course"))


# --- aggregates and windows -----------------------------------------------------------------------------------------------


@query("prevalence_ratio", f"WITH {SITES}, {_D}, z AS (SELECT type, km < 500 AS is_on FROM d WHERE km < 500 OR km > 1500), c AS (SELECT t.type, count(*) FILTER (WHERE z.type = t.type AND is_on)::DOUBLE / count(*) FILTER (WHERE is_on) AS a, count(*) FILTER (WHERE z.type = t.type AND NOT is_on)::DOUBLE / count(*) FILTER (WHERE NOT is_on) AS b FROM z, (SELECT DISTINCT type FROM sites) t GROUP BY t.type) SELECT type, round(a, 6) AS on_share, round(b, 6) AS off_share, round(a / b, 6) AS ratio FROM c")
def q_prevalence(spark, d):
    z = sites(spark, d).select("type", classify.zone(circle_km("lat", "lon"), 500.0, 1500.0).alias("zone")).where("zone is not null")
    c = z.groupBy("type").agg(F.count_if(F.col("zone") == "on").alias("a"), F.count_if(F.col("zone") == "off").alias("b"))
    w = Window.partitionBy(F.lit(0))
    c = c.withColumns({"on_share": F.col("a") / F.sum("a").over(w), "off_share": F.col("b") / F.sum("b").over(w)})
    return c.select("type", r6("on_share").alias("on_share"), r6("off_share").alias("off_share"), r6(F.try_divide("on_share", "off_share")).alias("ratio"))


@query("histogram", "SELECT l_returnflag AS g, least(floor((l_quantity - 1) / 4.9), 9)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY ALL")
def q_histogram(spark, d):
    return windows.histogram(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g"), ["g"], "l_quantity", 1.0, 50.0, 10)


@query("interpolated_bins", f"""WITH {_EV}, x AS (SELECT t AS a, min(value) AS v FROM e WHERE event_type = 'error' AND t >= -600 AND t <= 864000 GROUP BY 1), g AS (SELECT -600.0 + range * 600.0 AS lo FROM range(1441)), m AS (SELECT lo, avg(e.value) AS v FROM g JOIN e ON e.event_type = 'error' AND e.t >= lo AND e.t < lo + 600 AND e.t <= 864000 GROUP BY lo),
o AS (SELECT a, v, lag(a) OVER w AS pa, lag(v) OVER w AS pv, row_number() OVER w AS k, count(*) OVER () AS n FROM x WINDOW w AS (ORDER BY a)), s AS (SELECT CASE WHEN k = 2 THEN -1e300 ELSE pa END AS f, CASE WHEN k = n THEN 1e300 ELSE a END AS u, pa, pv, a, v FROM o WHERE k >= 2)
SELECT g.lo AS bin, round(coalesce(any_value(m.v), any_value(s.pv + (s.v - s.pv) * (g.lo + 300 - s.pa) / (s.a - s.pa))), 5) AS value FROM g LEFT JOIN m ON m.lo = g.lo JOIN s ON g.lo + 300 >= s.f AND g.lo + 300 < s.u GROUP BY g.lo""")
def q_interpolated(spark, d):
    return windows.interpolated_bins(events(spark, d).where("event_type = 'error'"), "t", "value", -600.0, 864000.0, 600.0).select("bin", r6("value", 5).alias("value"))


CURVE = [(0.0, 10.0), (2000.0, 4.0), (5000.0, -3.0), (9000.0, -8.0)]


@query("curve_lookup", f"WITH {SITES}, {_D} SELECT id, round(CASE WHEN km <= 0 THEN 10.0 WHEN km <= 2000 THEN 10.0 + km * -6.0 / 2000 WHEN km <= 5000 THEN 4.0 + (km - 2000) * -7.0 / 3000 WHEN km <= 9000 THEN -3.0 + (km - 5000) * -5.0 / 4000 ELSE -8.0 END, 6) AS level FROM d")
def q_curve(spark, d):
    return windows.on_curve(sites(spark, d).withColumn("km", circle_km("lat", "lon")), "km", CURVE, "level").select("id", r6("level").alias("level"))


@query("first_differences", f"WITH {_MONTHS}, x AS (SELECT m.n - lag(m.n) OVER (ORDER BY m.at) AS step FROM m) SELECT count(step) AS n, round(avg(abs(step)), 6) AS mean_step, max(step)::BIGINT AS top FROM x")
def q_differences(spark, d):
    x = months(spark, d).withColumn("step", F.col("n") - F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("at")))
    return x.agg(F.count("step").alias("n"), r6(F.avg(F.abs("step"))).alias("mean_step"), F.max("step").alias("top"))


@query("composite_score", "WITH k AS (SELECT o_custkey AS c, (count(*) FILTER (WHERE o_orderstatus = 'F') > 0)::INT + (count(*) FILTER (WHERE o_orderpriority = '1-URGENT') > 0)::INT + (max(o_totalprice) > 400000)::INT AS score FROM orders GROUP BY 1) SELECT score, count(*) AS n FROM k GROUP BY score")
def q_composite(spark, d):
    k = table(spark, d, "orders").groupBy("o_custkey").agg((F.bool_or(F.col("o_orderstatus") == "F").cast("int") + F.bool_or(F.col("o_orderpriority") == "1-URGENT").cast("int") + (F.max("o_totalprice") > 400000).cast("int")).alias("score"))
    return k.groupBy("score").agg(F.count("*").alias("n"))


@query("peak_segment", f"WITH {SITES}, c AS (SELECT type, floor({_frame_sql()[0]} / 10) * 10 AS seg, count(*) AS n FROM sites GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, seg) AS k FROM c) SELECT type, seg, n FROM r WHERE k = 1")
def q_peak(spark, d):
    c = sites(spark, d).groupBy("type", (F.floor(geo.arc_position("lat", "lon") / 10) * 10).cast("double").alias("seg")).agg(F.count("*").alias("n"))
    return c.groupBy("type").agg(F.max_by("seg", F.struct("n", -F.col("seg"))).alias("seg"), F.max("n").alias("n"))


@query("correlation_matrix", f"WITH {_EV}, s AS (SELECT event_type AS g, floor(t / 86400)::BIGINT AS day, sum(value) AS v FROM e GROUP BY ALL) SELECT a.g AS g1, b.g AS g2, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM s a JOIN s b ON a.day = b.day AND a.g < b.g GROUP BY ALL HAVING count(*) >= 3")
def q_corr_matrix(spark, d):
    s = events(spark, d).groupBy(F.col("event_type").alias("g"), F.floor(F.col("t") / 86400).alias("day")).agg(F.sum("value").alias("v"))
    a, b = s.select(F.col("g").alias("g1"), "day", F.col("v").alias("x")), s.select(F.col("g").alias("g2"), "day", F.col("v").alias("y"))
    return a.join(b, "day").where("g1 < g2").groupBy("g1", "g2").agg(F.count("*").alias("n"), r6(F.corr("x", "y")).alias("r")).where("n >= 3")


@query("oldest_per_cluster", "WITH r AS (SELECT c_nationkey AS nation, c_custkey AS id, c_acctbal AS age, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT nation, id, age FROM r WHERE k <= 5")
def q_oldest(spark, d):
    w = Window.partitionBy("nation").orderBy(F.col("age").desc(), "id")
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("age")).withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


@query("union_split", f"WITH {SITES}, {SITES2}, u AS (SELECT 'a' AS src, id, lat, lon FROM sites UNION ALL SELECT 'b', id, lat, lon FROM sites2), h AS (SELECT *, {nulls.draw_int_sql(91, '0', 'id')} % 2 = 0 AS half FROM u) SELECT src, half, count(*) AS n, round(avg(lat), 6) AS lat FROM h GROUP BY ALL")
def q_union(spark, d):
    u = sites(spark, d).select(F.lit("a").alias("src"), "id", "lat", "lon").unionByName(sites2(spark, d).select(F.lit("b").alias("src"), "id", "lat", "lon"))
    half = F.pmod(nulls.draw_int(91, F.lit(0), F.col("id")), F.lit(2)) == 0
    return u.groupBy("src", half.alias("half")).agg(F.count("*").alias("n"), r6(F.avg("lat")).alias("lat"))


# --- nulls and tests ------------------------------------------------------------------------------------------------------

_N = 30


def _trials(spark, d, columns):
    return nulls.trials_of(sites(spark, d).select(*columns), _N)


@query("rotation_null", f"WITH {SITES}, a AS (SELECT id, {_frame_sql()[0]} AS arc FROM sites WHERE {circle()} <= 500), t AS (SELECT range AS trial, 360.0 * {nulls.uniform_sql(15, 'range', '0')} AS turn FROM range({_N})) SELECT trial, count(*) FILTER (WHERE ((arc + turn) % 360) < 90) AS n FROM a, t GROUP BY trial")
def q_rotation(spark, d):
    near = sites(spark, d).where(circle_km("lat", "lon") <= 500).select(geo.arc_position("lat", "lon").alias("arc"))
    t = nulls.trials_of(near, _N)
    turned = F.pmod(F.col("arc") + 360.0 * nulls.uniform(15, F.col("trial"), F.lit(0)), F.lit(360.0))
    return t.groupBy("trial").agg(F.count_if(turned < 90).alias("n"))


@query("shuffle_null", f"WITH {SITES}, {_D}, t AS (SELECT range AS trial, id, bal, km FROM range({_N}), d), a AS (SELECT trial, km, row_number() OVER (PARTITION BY trial ORDER BY {nulls.draw_int_sql(21, 'trial', 'id')}, id) AS k FROM t), b AS (SELECT trial, bal, row_number() OVER (PARTITION BY trial ORDER BY {nulls.draw_int_sql(22, 'trial', 'id')}, id) AS k FROM t) SELECT a.trial, round(corr(km, bal), 6) AS r FROM a JOIN b ON a.trial = b.trial AND a.k = b.k GROUP BY a.trial")
def q_shuffle(spark, d):
    from arcspan.operators.ranking import rank_within

    t = nulls.trials_of(sites(spark, d).select("id", "bal", circle_km("lat", "lon").alias("km")), _N)
    a = rank_within(t.select("trial", "id", "km", nulls.draw_int(21, F.col("trial"), F.col("id")).alias("h")), ["trial"], ["h"], ["id"]).select("trial", "rank", "km")
    b = rank_within(t.select("trial", "id", "bal", nulls.draw_int(22, F.col("trial"), F.col("id")).alias("h")), ["trial"], ["h"], ["id"]).select("trial", "rank", "bal")
    return a.join(b, ["trial", "rank"]).groupBy("trial").agg(r6(F.corr("km", "bal")).alias("r"))


@query("subsample_null", f"WITH {SITES}, {_D}, t AS (SELECT range AS trial, id, km FROM range({_N}), d), k AS (SELECT trial, km, row_number() OVER (PARTITION BY trial ORDER BY {nulls.draw_int_sql(25, 'trial', 'id')}, id) AS k FROM t) SELECT trial, count(*) FILTER (WHERE km < 200) AS n FROM k WHERE k <= 300 GROUP BY trial")
def q_subsample(spark, d):
    """A sample of 300 without replacement in each trial, by hash order: the size of the class under test."""
    from arcspan.operators.ranking import rank_within

    t = nulls.trials_of(sites(spark, d).select("id", circle_km("lat", "lon").alias("km")), _N)
    ranked = rank_within(t.withColumn("h", nulls.draw_int(25, F.col("trial"), F.col("id"))), ["trial"], ["h"], ["id"])
    return ranked.where("rank < 300").groupBy("trial").agg(F.count_if(F.col("km") < 200).alias("n"))


@query("uniform_box_null", f"WITH p AS (SELECT a.range AS trial, 22.0 + 10.0 * {nulls.uniform_sql(31, 'a.range', 'b.range')} AS lat, 25.0 + 10.0 * {nulls.uniform_sql(32, 'a.range', 'b.range')} AS lon FROM range({_N}) a, range(500) b) SELECT trial, count(*) FILTER (WHERE {circle()} <= 100) AS n FROM p GROUP BY trial")
def q_box(spark, d):
    t = nulls.trials_of(spark.range(500), _N)
    u = lambda s: nulls.uniform(s, F.col("trial"), F.col("id"))
    return t.select("trial", (22.0 + 10.0 * u(31)).alias("lat"), (25.0 + 10.0 * u(32)).alias("lon")).groupBy("trial").agg(F.count_if(circle_km("lat", "lon") <= 100).alias("n"))


@query("conditioned_poles", f"WITH {_POLES}, b AS (SELECT pole_id, plat, plon, range AS br FROM poles, range(360)), t AS (SELECT pole_id, degrees(asin(cos(radians(plat)) * cos(radians(br)))) AS la, plat, plon, br FROM b), q AS (SELECT pole_id, la, ((((plon + degrees(atan2(sin(radians(br)) * cos(radians(plat)), -sin(radians(plat)) * sin(radians(la)))) + 180) % 360) + 360) % 360) - 180 AS lo FROM t) SELECT DISTINCT pole_id FROM q WHERE la BETWEEN 10 AND 40 AND lo BETWEEN 20 AND 50")
def q_conditioned(spark, d):
    drawn = nulls.random_poles(spark.range(200).select(F.col("id").alias("pole_id")), 5)
    return poles.through_box(drawn, 10.0, 40.0, 20.0, 50.0).select("pole_id")


@query("compound_hits", f"WITH {_POLES}, c(k, clat, clon) AS (VALUES (1, 29.98, 31.13), (2, -14.7, -75.1), (3, -27.1, -109.3), (4, 27.3, 68.1)), h AS (SELECT pole_id, count(*) FILTER (WHERE abs({hav('clat', 'clon', 'plat', 'plon')} - {geo.QUARTER_KM!r}) <= 800) AS hits FROM poles, c GROUP BY pole_id) SELECT hits, count(*) AS n FROM h GROUP BY hits")
def q_compound(spark, d):
    drawn = nulls.random_poles(spark.range(200).select(F.col("id").alias("pole_id")), 5)
    near = [(F.abs(haversine_km(F.lit(a), F.lit(o), "lat", "lon") - geo.QUARTER_KM) <= 800).cast("int") for a, o in ((29.98, 31.13), (-14.7, -75.1), (-27.1, -109.3), (27.3, 68.1))]
    return drawn.groupBy(sum(near[1:], near[0]).cast("long").alias("hits")).agg(F.count("*").alias("n"))


@query("two_site_poles", f"WITH {SITES}, v AS (SELECT id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z, cos(radians(29.9792)) * cos(radians(31.1342)) AS gx, cos(radians(29.9792)) * sin(radians(31.1342)) AS gy, sin(radians(29.9792)) AS gz FROM sites WHERE id % 50 = 0), c AS (SELECT id, y * gz - z * gy AS nx, z * gx - x * gz AS ny, x * gy - y * gx AS nz FROM v) SELECT id, round(degrees(asin(abs(nz) / sqrt(nx * nx + ny * ny + nz * nz))), 6) AS pole_lat FROM c")
def q_two_site(spark, d):
    """Poles of the circles through a fixed place and every site whose id is divisible by 50."""
    lat, _ = geo.pole_through("lat", "lon", *geo.GIZA)
    return sites(spark, d).where(F.col("id") % 50 == 0).select("id", r6(lat).alias("pole_lat"))


@query("contingency", f"WITH {SITES}, {_D}, t AS (SELECT count(*) FILTER (WHERE m AND n) AS a, count(*) FILTER (WHERE m AND NOT n) AS b, count(*) FILTER (WHERE NOT m AND n) AS c, count(*) FILTER (WHERE NOT m AND NOT n) AS d FROM (SELECT cls = 'monument' AS m, km <= 1000 AS n FROM d)) SELECT a, b, c, d, round(a * d / (b * c)::DOUBLE, 6) AS odds, round((a + b + c + d)::DOUBLE * (a * d - b * c) * (a * d - b * c) / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)), 6) AS chi2 FROM t")
def q_contingency(spark, d):
    t = stats.two_by_two(sites(spark, d), F.col("cls") == "monument", circle_km("lat", "lon") <= 1000)
    return t.select("a", "b", "c", "d", r6("odds").alias("odds"), r6("chi2").alias("chi2"))


@query("fisher_exact", f"WITH {SITES}, {_D}, t AS (SELECT count(*) FILTER (WHERE m AND n) AS a, count(*) FILTER (WHERE m AND NOT n) AS b, count(*) FILTER (WHERE NOT m AND n) AS c, count(*) FILTER (WHERE NOT m AND NOT n) AS d FROM (SELECT cls = 'monument' AS m, km <= 1000 AS n FROM d)), x AS (SELECT unnest(range(a, least(a + b, a + c) + 1)) AS x, * FROM t) SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, round(least(1.0, sum(exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - CASE WHEN x > 0 THEN lgamma(x + 1) ELSE 0 END - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)))), 6) AS p FROM x")
def q_fisher(spark, d):
    return stats.two_by_two(sites(spark, d), F.col("cls") == "monument", circle_km("lat", "lon") <= 1000).select("a", "b", "c", "d", r6("p").alias("p"))


@query("ks_distance", f"WITH {SITES}, c AS (SELECT bal, count(*) FILTER (WHERE cls = 'monument') AS x, count(*) FILTER (WHERE cls <> 'monument') AS y FROM sites GROUP BY bal), e AS (SELECT sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x) OVER () AS n1, sum(y) OVER () AS n2 FROM c WINDOW w AS (ORDER BY bal)) SELECT round(max(abs(sx / n1 - sy / n2)), 6) AS d, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2 FROM e")
def q_ks(spark, d):
    return stats.kolmogorov_smirnov(sites(spark, d), "bal", "cls", "monument").select(r6("d").alias("d"), "n1", "n2")


@query("cohens_d", f"WITH {SITES} SELECT count(bal) FILTER (WHERE cls = 'monument') AS n1, count(bal) FILTER (WHERE cls <> 'monument') AS n2, round((avg(bal) FILTER (WHERE cls = 'monument') - avg(bal) FILTER (WHERE cls <> 'monument')) / sqrt(((count(*) FILTER (WHERE cls = 'monument') - 1) * var_samp(bal) FILTER (WHERE cls = 'monument') + (count(*) FILTER (WHERE cls <> 'monument') - 1) * var_samp(bal) FILTER (WHERE cls <> 'monument')) / (count(*) - 2)), 6) AS d FROM sites")
def q_cohens(spark, d):
    return stats.cohens_d(sites(spark, d), "bal", "cls", "monument").select("n1", "n2", r6("d").alias("d"))


@query("global_moran", f"WITH {SITES}, m AS (SELECT avg(bal) AS m, var_pop(bal) AS v FROM sites), p AS (SELECT a.bal AS x, b.bal AS y, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM sites a JOIN sites b ON a.id <> b.id AND abs(a.lat - b.lat) <= 1.8) SELECT round(sum((x - m) * (y - m) / km) / (sum(1 / km) * any_value(v)), 6) AS i FROM p, m WHERE km <= 200 AND km > 0")
def q_global_moran(spark, d):
    return stats.global_moran(sites(spark, d), "id", "bal", 200.0).select(r6("i").alias("i"))


@query("null_rank", f"WITH {SITES}, {_POLES}, c AS (SELECT pole_id, count(*) FILTER (WHERE {_DOT} <= {band_sine(200.0)!r}) AS n FROM sites, poles GROUP BY pole_id), o AS (SELECT count(*) FILTER (WHERE {circle()} <= 200) AS obs FROM sites), g AS (SELECT count(*) FILTER (WHERE n >= obs) AS ge, count(*) AS n FROM c, o) SELECT ge + 1 AS rank, n AS trials, round((1 - (ge + 1) / (n + 1.0)) * 100, 6) AS percentile, round(sqrt((ge + 1) / (n + 1.0) * (1 - (ge + 1) / (n + 1.0)) / n), 6) AS se FROM g")
def q_null_rank(spark, d):
    s = sites(spark, d)
    drawn = nulls.random_poles(spark.range(200).select(F.col("id").alias("pole_id")), 5).collect()  # as many as were asked for
    counts = poles.pole_counts(s, [(r["pole_id"], r["lat"], r["lon"]) for r in drawn], 200.0)
    observed = s.agg(F.count_if(circle_km("lat", "lon") <= 200)).first()[0]
    return windows.rank_in_null(counts, "n", observed).select("rank", "trials", r6("percentile").alias("percentile"), r6("se").alias("se"))


@query("speed_parts", f"WITH {SITES}, t AS (SELECT id, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM sites WINDOW w AS (PARTITION BY nation ORDER BY id)), k AS (SELECT id, {hav('lat', 'lon', 'lat2', 'lon2')} AS km, {bearing('lat', 'lon', 'lat2', 'lon2')} - ({bearing('lat', 'lon', '59.682122', '-138.646087')} + 90) AS turn FROM t WHERE lat2 IS NOT NULL) SELECT id, round(abs(km * cos(radians(turn))), 4) AS along_km, round(abs(km * sin(radians(turn))), 4) AS across_km FROM k")
def q_speed(spark, d):
    t = joins.consecutive(sites(spark, d).select("nation", "id", "lat", "lon"), ["nation"], ["id"], ["lat", "lon"])
    along, across = geo.along_across(haversine_km("lat", "lon", "next_lat", "next_lon"), geo.bearing("lat", "lon", "next_lat", "next_lon"), "lat", "lon")
    return t.select("id", r6(along, 4).alias("along_km"), r6(across, 4).alias("across_km"))


@query("pair_residuals", f"WITH {SITES}, p AS (SELECT o_custkey AS c, l_suppkey AS s, avg(l_discount) AS fst FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), {SITES2}, x AS (SELECT fst / (1 - fst) AS y, ln({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS x, CASE WHEN na AND nb THEN 'on' WHEN na OR nb THEN 'mixed' ELSE 'off' END AS cls FROM p JOIN (SELECT *, {circle()} <= 1000 AS na FROM sites) a ON a.id = c JOIN (SELECT *, {circle()} <= 1000 AS nb FROM sites2) b ON b.id = s WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} > 0), l AS (SELECT regr_slope(y, x) AS k, regr_intercept(y, x) AS i FROM x) SELECT cls, count(*) AS n, round(avg(y - i - k * x), 8) AS residual FROM x, l GROUP BY cls")
def q_pair_residuals(spark, d):
    fst = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).agg(F.avg("l_discount").alias("fst"))
    a = sites(spark, d).select(F.col("id").alias("c"), F.col("lat").alias("la"), F.col("lon").alias("lo"), (circle_km("lat", "lon") <= 1000).alias("na"))
    b = sites2(spark, d).select(F.col("id").alias("s"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), (circle_km("lat", "lon") <= 1000).alias("nb"))
    p = fst.join(a, "c").join(b, "s").withColumn("km", haversine_km("la", "lo", "lb", "ob")).where("km > 0")
    x = p.select((F.col("fst") / (1 - F.col("fst"))).alias("y"), F.ln("km").alias("x"), F.when(F.col("na") & F.col("nb"), "on").when(F.col("na") | F.col("nb"), "mixed").otherwise("off").alias("cls"))
    return stats.residuals(x, "x", "y").groupBy("cls").agg(F.count("*").alias("n"), r6(F.avg("residual"), 8).alias("residual"))


@query("year_labels", "SELECT abs(y)::VARCHAR || CASE WHEN y < 0 THEN ' BCE' ELSE ' CE' END AS label, count(*) AS n FROM (SELECT (c_nationkey * 100 - 1200) AS y FROM customer) GROUP BY 1")
def q_labels(spark, d):
    return table(spark, d, "customer").groupBy(dates.year_label(F.col("c_nationkey") * 100 - 1200).alias("label")).agg(F.count("*").alias("n"))


@query("circle_angles", f"WITH {SITES}, a AS (SELECT id, degrees(acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(59.682122)) + cos(radians(lat)) * cos(radians(59.682122)) * cos(radians(-138.646087 - lon)))))) AS s, sin(radians(23.44)) / cos(radians(lat)) AS c FROM sites) SELECT id, round(least(s, 180 - s), 6) AS inclination, round(CASE WHEN abs(c) <= 1 THEN degrees(acos(c)) END, 6) AS sunrise FROM a")
def q_angles(spark, d):
    return sites(spark, d).select("id", r6(geo.mutual_inclination("lat", "lon", *geo.DEFAULT_POLE)).alias("inclination"), r6(geo.sunrise_azimuth("lat")).alias("sunrise"))


@query("polyline_crossings", f"WITH {SITES}, s AS (SELECT nation, id, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM sites WINDOW w AS (PARTITION BY nation ORDER BY id)), h AS (SELECT nation, {_frame_sql()[1]} AS ha, {_frame_sql()[1].replace('lat', 'lat2').replace('lon', 'lon2')} AS hb FROM s WHERE lat2 IS NOT NULL AND abs(lon2 - lon) <= 180) SELECT nation, count(*) FILTER (WHERE ha * hb <= 0 AND ha <> hb) AS crossings FROM h GROUP BY nation")
def q_polylines(spark, d):
    from arcspan.operators import lines

    s = sites(spark, d).select("nation", "id", "lat", "lon")
    n = lines.crossings(s, "nation", "id").groupBy("nation").agg(F.count("*").alias("c"))
    return s.select("nation").distinct().join(n, "nation", "left").select("nation", F.coalesce("c", F.lit(0)).alias("crossings"))


@query("route_lengths", f"WITH {SITES}, s AS (SELECT nation, {circle()} AS d, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS km, lag(lat) OVER w AS p FROM sites WINDOW w AS (PARTITION BY nation ORDER BY id)) SELECT nation, round(sum(CASE WHEN p IS NOT NULL THEN km ELSE 0 END), 3) AS km, count(*) AS points, round(sqrt(avg(d * d)), 5) AS rms_circle_km FROM s GROUP BY nation")
def q_lengths(spark, d):
    from arcspan.operators import lines

    return lines.lengths(sites(spark, d).select("nation", "id", "lat", "lon"), "nation", "id").select("nation", r6("km", 3).alias("km"), "points", r6("rms_circle_km", 5).alias("rms_circle_km"))


@query("straight_deviation", f"WITH {SITES}, e AS (SELECT nation, id, lat, lon, row_number() OVER (PARTITION BY nation ORDER BY id) AS k, count(*) OVER p AS n, arg_min(lat, id) OVER p AS a0, arg_max(lat, id) OVER p AS a1, arg_min(lon, id) OVER p AS o0, arg_max(lon, id) OVER p AS o1 FROM sites WINDOW p AS (PARTITION BY nation)), f AS (SELECT *, {hav('a0', 'o0', 'lat', 'lon')} AS ds, {hav('lat', 'lon', 'a1', 'o1')} AS de, {hav('a0', 'o0', 'a1', 'o1')} AS total FROM e), g AS (SELECT *, CASE WHEN total > 0 THEN ds / (ds + de) ELSE 0.5 END AS frac FROM f), d AS (SELECT nation, k, n, {hav('lat', 'lon', 'a0 + frac * (a1 - a0)', 'o0 + frac * (o1 - o0)')} AS d FROM g) SELECT nation, round(coalesce(sqrt(avg(d * d) FILTER (WHERE k > 1 AND k < n)), 0), 5) AS rms_km FROM d GROUP BY nation")
def q_straight(spark, d):
    from arcspan.operators import lines

    return lines.straight_deviation(sites(spark, d).select("nation", "id", "lat", "lon"), "nation", "id").select("nation", r6("rms_km", 5).alias("rms_km"))


@query("pole_errors", f"WITH {SITES}, grid AS (SELECT (a.range * 12 + b.range) AS pole_id, a.range * 30.0 AS plat, b.range * 30.0 - 180.0 AS plon FROM range(4) a, range(12) b), d AS (SELECT pole_id, cls, 6371.0 * asin(least(1.0, {_DOT})) AS km FROM sites, grid) SELECT pole_id, cls, count(*) AS n, round(avg(km), 5) AS mean_km, round(sqrt(avg(km * km)), 5) AS rms_km, round(max(km), 5) AS max_km FROM d GROUP BY ALL")
def q_pole_errors(spark, d):
    e = poles.pole_errors(sites(spark, d), poles.pole_grid(30.0), "cls")
    return e.select("pole_id", "cls", "n", *[r6(c, 5).alias(c) for c in ("mean_km", "rms_km", "max_km")])


@query("position_index", "WITH grid AS (SELECT a.range AS row, b.range AS col, ((a.range * 37 + b.range * 91) % 1000) / 10.0 AS value FROM range(37) a, range(72) b) SELECT a.row::INT AS row, a.col::INT AS col, round(any_value(a.value) - avg(b.value), 6) AS tpi  FROM grid a JOIN grid b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col")
def q_position(spark, d):
    from arcspan.operators import raster
    from arcspan.plans.reference_stats import _grid

    return raster.position_index(_grid(spark), 2).select("row", "col", r6("tpi").alias("tpi"))


_ELEV = lambda la, lo: f"((((round_even((90.0 - ({la})) / 5.0, 0)::BIGINT) * 37 + ((round_even((({lo}) + 180.0) / 5.0, 0)::BIGINT) % 72) * 91) % 1000) / 10.0 - 30.0)"


@query("prominence", f"WITH {SITES}, c AS (SELECT id, lat, lon, {_ELEV('lat', 'lon')} AS e FROM sites WHERE abs(lat) < 85), a AS (SELECT range * 2 * pi() / 64 AS ang FROM range(64)), f AS (SELECT unnest([0.33, 0.67, 1.0])::DOUBLE AS f), q AS (SELECT id, e, lat + 500.0 * f * sin(ang) * (1.0 / 111.0) AS la, lon + 500.0 * f * cos(ang) * (1.0 / (111.0 * greatest(cos(radians(lat)), 0.01))) AS lo FROM c, a, f), s AS (SELECT id, e, {_ELEV('la', '((lo + 180) % 360 + 360) % 360 - 180')} AS v FROM q WHERE la BETWEEN -90 AND 90) SELECT id, round(CASE WHEN any_value(e) > 0 THEN any_value(e) - avg(greatest(v, 0)) END, 6) AS prominence FROM s GROUP BY id HAVING count(*) >= 10")
def q_prominence(spark, d):
    from arcspan.operators import raster
    from arcspan.plans.reference_stats import _grid

    ground = _grid(spark).withColumn("value", F.col("value") - 30.0)
    scaled = F.col("prominence") * 1e6
    rounded = F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 1e6  # as the SQL rounds; round() goes by the decimal digits, and halves are common here
    return raster.prominence(sites(spark, d).where(F.abs("lat") < 85), ground, 5.0, "id", 500.0).select("id", rounded.alias("prominence"))


@query("feature_auc")
def q_auc(spark, d):
    """Held-out areas under the curve of telling monuments from settlements by distance, latitude and neighbours."""
    from arcspan.operators import learning

    s = sites(spark, d).where("cls <> 'other'")
    rows = s.select("id", circle_km("lat", "lon").alias("km"), F.abs("lat").alias("abs_lat"), "bal", (F.col("cls") == "monument").cast("double").alias("label"))
    return spark.createDataFrame([(k, round(a, 6)) for k, a in enumerate(learning.auc_by_fold(rows, ["km", "abs_lat", "bal"], "label", "id", 3))], "fold int, auc double")


@query("jittered_floor_null", f"WITH {SITES}, n AS (SELECT count(*) AS n FROM sites), t AS (SELECT range AS trial, id AS slot, {nulls.draw_int_sql(55, 'range', 'id')} % n.n AS id FROM range({_N}), sites, n), p AS (SELECT trial, lat + 2.0 * {nulls.normal_sql(57, 'trial', 'slot')} AS lat, lon + 2.0 * {nulls.normal_sql(59, 'trial', 'slot')} AS lon FROM t JOIN sites USING (id)), c AS (SELECT trial, count(*) FILTER (WHERE {circle()} < 100) AS n FROM p GROUP BY trial), o AS (SELECT count(*) FILTER (WHERE {circle()} < 100) AS obs FROM sites) SELECT any_value(obs) AS observed, round(avg(n), 6) AS mu, round(greatest(stddev_pop(n), 1.0), 6) AS sigma, round((any_value(obs) - avg(n)) / greatest(stddev_pop(n), 1.0), 6) AS z FROM c, o")
def q_floor_null(spark, d):
    s = sites(spark, d).select(F.col("id").alias("row"), "lat", "lon")
    p = nulls.matched_points(s, _N, s.count(), clamp=False, seed=55)
    null = p.groupBy("trial", F.lit(0).alias("k")).agg(F.count_if(circle_km("lat", "lon") < 100).alias("n"))
    observed = s.groupBy(F.lit(0).alias("k")).agg(F.count_if(circle_km("lat", "lon") < 100).alias("n"))
    return nulls.null_summary(observed, null, ["k"], _N, 1.0).select("observed", r6("mu").alias("mu"), r6("sigma").alias("sigma"), r6("z").alias("z"))


@query("site_keywords", "WITH k AS (SELECT CASE WHEN SiteName IS NULL OR SiteName = '' THEN 'unclassified' WHEN regexp_matches(lower(SiteName), '" + "|".join(classify.MONUMENTAL_WORDS) + "') THEN 'monumental' WHEN regexp_matches(lower(SiteName), '" + "|".join(classify.DOMESTIC_WORDS) + "') THEN 'domestic' ELSE 'unclassified' END AS cls FROM p3k14c_data) SELECT cls, count(*) AS n FROM k GROUP BY cls")
def q_site_keywords(spark, d):
    cls = classify.keyword_class("SiteName", [("monumental", classify.MONUMENTAL_WORDS), ("domestic", classify.DOMESTIC_WORDS)], "unclassified")
    return table(spark, d, "p3k14c_data").groupBy(cls.alias("cls")).agg(F.count("*").alias("n"))


@query("years_bce", "SELECT CASE WHEN TRY_CAST(trim(minDate) AS DOUBLE) IS NOT NULL THEN -TRY_CAST(trim(minDate) AS DOUBLE) WHEN regexp_matches(trim(minDate), '^\\d+\\s*BCE?', 'i') THEN regexp_extract(trim(minDate), '^(\\d+)', 1)::DOUBLE WHEN regexp_matches(trim(minDate), '^\\d+\\s*(CE|AD)', 'i') THEN -(regexp_extract(trim(minDate), '^(\\d+)', 1)::DOUBLE) END + 0.0 AS bce, count(*) AS n FROM pleiades_places_latest GROUP BY 1")
def q_years_bce(spark, d):
    return table(spark, d, "pleiades_places_latest").groupBy((dates.years_bce("minDate") + 0.0).alias("bce")).agg(F.count("*").alias("n"))


@query("valley_periods", "SELECT CASE " + " ".join(f"WHEN {'y >= ' + str(a) if a is not None else 'TRUE'} AND {'y < ' + str(b) if b is not None else 'TRUE'} THEN '{k}'" for k, a, b in classify.VALLEY_PERIODS) + " ELSE 'other' END AS period, count(*) AS n FROM (SELECT TRY_CAST(minDate AS DOUBLE) AS y FROM pleiades_places_latest) WHERE y IS NOT NULL GROUP BY 1")
def q_valley(spark, d):
    y = table(spark, d, "pleiades_places_latest").select(F.expr("try_cast(minDate as double)").alias("y")).where("y is not null")
    return y.groupBy(classify.period("y", classify.VALLEY_PERIODS).alias("period")).agg(F.count("*").alias("n"))


@query("hollow_stages", "WITH k AS (SELECT CASE p_size % 5 WHEN 0 THEN 'natural_cave' WHEN 1 THEN 'modified_cave' WHEN 2 THEN 'rock_cut_monumental' WHEN 3 THEN 'artificial_complex' ELSE 'utilitarian' END AS t, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 60 * 1000 END AS bp FROM part) SELECT t AS subtype, CASE WHEN t = 'natural_cave' THEN CASE WHEN bp >= 5000 AND bp < 10000 THEN 3 ELSE 1 END WHEN t = 'modified_cave' THEN CASE WHEN bp >= 5000 AND bp < 10000 THEN 3 ELSE 2 END WHEN t = 'rock_cut_monumental' AND bp IS NULL THEN 5 WHEN t = 'rock_cut_monumental' AND bp < 3000 THEN 5 WHEN t = 'rock_cut_monumental' THEN 4 WHEN t = 'artificial_complex' THEN 6 END AS stage, count(*) AS n FROM k GROUP BY ALL")
def q_stages(spark, d):
    kinds = F.array(*map(F.lit, ("natural_cave", "modified_cave", "rock_cut_monumental", "artificial_complex", "utilitarian")))
    k = table(spark, d, "part").select(F.element_at(kinds, (F.col("p_size") % 5 + 1).cast("int")).alias("subtype"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_partkey") % 60 * 1000).alias("bp"))
    return k.groupBy("subtype", classify.stage("subtype", "bp").alias("stage")).agg(F.count("*").alias("n"))


# --- the rest ---------------------------------------------------------------------------------------------------------------


@query("sampled_circle_distance", f"WITH {SITES}, p AS (SELECT range AS bearing, degrees(asin(cos(radians(59.682122)) * cos(radians(range)))) AS plat FROM range(360)), q AS (SELECT plat, -138.646087 + degrees(atan2(sin(radians(bearing)) * cos(radians(59.682122)), -sin(radians(59.682122)) * sin(radians(plat)))) AS plon FROM p) SELECT id, round(min({hav('lat', 'lon', 'plat', 'plon')}), 6) AS km FROM sites, q GROUP BY id")
def q_sampled(spark, d):
    trace = spark.range(360).select("id", geo.point_lat(F.col("id")).alias("lat"), geo.point_lon(F.col("id"), wrapped=True).alias("lon"))
    return joins.nearest(sites(spark, d), trace, "id", "id").select("id", r6("km").alias("km"))


@query("arc_origins", f"WITH {SITES} SELECT id, round({bearing('59.682122', '-138.646087', 'lat', 'lon')}, 5) AS from_north, round({_frame_sql()[0]}, 5) AS from_giza FROM sites")
def q_origins(spark, d):
    return sites(spark, d).select("id", r6(geo.pole_bearing("lat", "lon"), 5).alias("from_north"), r6(geo.arc_position("lat", "lon"), 5).alias("from_giza"))


@query("offset_points", f"WITH {SITES} SELECT id, round(lat + (59.682122 - lat) * 0.01, 6) AS lat, round(lon + ((((-138.646087 - lon + 180) % 360 + 360) % 360) - 180) * 0.01, 6) AS lon FROM sites")
def q_offset(spark, d):
    la, lo = geo.offset_toward_pole("lat", "lon", 0.01)
    return sites(spark, d).select("id", r6(la).alias("lat"), r6(lo).alias("lon"))


_NATIONS = "p AS (SELECT n_nationkey AS id, ((n_nationkey * 7919) % 18001) / 100.0 - 90.0 AS lat, ((n_nationkey * 104729) % 36001) / 100.0 - 180.0 AS lon FROM nation)"


@query("triplets", f"WITH {_NATIONS}, t AS (SELECT a.id AS a, b.id AS b, c.id AS c, sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) AS ab, sqrt(pow(c.lon - b.lon, 2) + pow(c.lat - b.lat, 2)) AS bc, sqrt(pow(c.lon - a.lon, 2) + pow(c.lat - a.lat, 2)) AS ca FROM p a JOIN p b ON a.id < b.id JOIN p c ON b.id < c.id) SELECT a, b, c, round(degrees(greatest(acos(greatest(-1, least(1, (ab * ab + ca * ca - bc * bc) / (2 * ab * ca)))), acos(greatest(-1, least(1, (ab * ab + bc * bc - ca * ca) / (2 * ab * bc)))), acos(greatest(-1, least(1, (bc * bc + ca * ca - ab * ab) / (2 * bc * ca)))))), 3) AS widest FROM t")
def q_triplets(spark, d):
    """Triples of a stated list of places, cut to pieces by array functions; the list is refused beyond 200 places."""
    n = table(spark, d, "nation")
    p = n.select(F.struct(F.col("n_nationkey").alias("id"), (F.pmod(F.col("n_nationkey") * 7919, F.lit(18001)) / 100.0 - 90.0).alias("lat"), (F.pmod(F.col("n_nationkey") * 104729, F.lit(36001)) / 100.0 - 180.0).alias("lon")).alias("x"))
    if n.limit(201).count() > 200:
        raise ValueError("triples are made of a stated list of at most 200 places")
    one = p.agg(F.sort_array(F.collect_list("x")).alias("all"))
    two = one.select("all", F.posexplode("all").alias("i", "a")).select("a", F.expr("slice(all, i + 2, 200)").alias("rest"))
    three = two.select("a", "rest", F.posexplode("rest").alias("j", "b")).select("a", "b", F.explode(F.expr("slice(rest, j + 2, 200)")).alias("c"))
    return three.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("c.id").alias("c"), r6(geo.collinearity("a.lat", "a.lon", "b.lat", "b.lon", "c.lat", "c.lon"), 3).alias("widest"))


@query("substring_anti_join", "WITH w AS (SELECT unnest(['ring', 'small', 'blue bolt extra', 'red']) AS word) SELECT p_name, count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM w WHERE contains(p_name, word) OR contains(word, p_name)) GROUP BY p_name")
def q_substring(spark, d):
    words = F.array(*map(F.lit, ("ring", "small", "blue bolt extra", "red")))
    clash = F.exists(words, lambda w: F.contains(F.col("p_name"), w) | F.contains(w, F.col("p_name")))
    return table(spark, d, "part").where(~clash).groupBy("p_name").agg(F.count("*").alias("n"))


@query("mode_value", "WITH c AS (SELECT o_orderpriority AS g, o_custkey, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, o_custkey) AS k FROM c) SELECT g, o_custkey AS most, n FROM r WHERE k = 1")
def q_mode(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("g"), "o_custkey").agg(F.count("*").alias("n"))
    return c.groupBy("g").agg(F.max_by("o_custkey", F.struct("n", -F.col("o_custkey"))).alias("most"), F.max("n").alias("n"))


@query("dedup_first_site", "SELECT SiteID AS site, min(rec_id) AS rec_id FROM p3k14c_data WHERE trim(SiteID) <> '' GROUP BY 1")
def q_first_site(spark, d):
    from arcspan.operators.dedup import first_by_key
    from arcspan.plans.runtime import not_blank

    t = table(spark, d, "p3k14c_data").where(not_blank("SiteID")).select("SiteID", "rec_id")
    return first_by_key(t, {"site": F.col("SiteID")}, ["rec_id"]).select("site", "rec_id")


@query("corridor_k", f"WITH {SITES}, {_POLES}, r AS (SELECT unnest([50.0, 100.0, 200.0, 400.0, 800.0, 1600.0])::DOUBLE AS km), c AS (SELECT r.km, pole_id, count(*) FILTER (WHERE {_DOT} <= sin(r.km / 6371.0)) AS n FROM sites, poles, r GROUP BY ALL), o AS (SELECT r.km, count(*) FILTER (WHERE {circle()} <= r.km) AS obs FROM sites, r GROUP BY r.km) SELECT km, any_value(obs) AS observed, round(any_value(obs) / avg(n) - 1, 6) AS l, round((any_value(obs) - avg(n)) / stddev_pop(n), 6) AS z, round(quantile_cont(n, 0.025), 6) AS low, round(quantile_cont(n, 0.975), 6) AS high FROM c JOIN o USING (km) GROUP BY km")
def q_corridor_k(spark, d):
    s, radii = sites(spark, d), [50.0, 100.0, 200.0, 400.0, 800.0, 1600.0]
    drawn = nulls.random_poles(spark.range(200).select(F.col("id").alias("pole_id")), 5).collect()  # as many as were asked for
    c = poles.pole_counts(s, [(r["pole_id"], r["lat"], r["lon"]) for r in drawn], radii)
    n = c.groupBy("km").agg(F.avg("n").alias("mu"), F.stddev_pop("n").alias("sd"), F.percentile("n", 0.025).alias("low"), F.percentile("n", 0.975).alias("high"))
    o = nulls.corridor_counts(s.withColumn("k", F.lit(0)), radii, ["k"]).select("km", F.col("n").alias("observed"))
    return o.join(n, "km").select("km", "observed", r6(F.col("observed") / F.col("mu") - 1).alias("l"), r6((F.col("observed") - F.col("mu")) / F.col("sd")).alias("z"), r6("low").alias("low"), r6("high").alias("high"))


@query("kde_peaks", f"WITH {SITES}, b AS (SELECT floor({_frame_sql()[0]} / 0.25) * 0.25 + 0.125 AS c, count(*) AS n FROM sites GROUP BY 1), g AS (SELECT range AS k FROM range(72)), f AS (SELECT k, sum(n * exp(-0.5 * pow(abs(((k * 5.0 - c + 180.0 + 360.0) % 360) - 180.0) / 8.0, 2)) / (8.0 * sqrt(2 * pi()))) AS v FROM b, g GROUP BY k) SELECT a.k * 5.0 AS at, round(a.v, 6) AS density FROM f a JOIN f l ON l.k = (a.k + 71) % 72 JOIN f r ON r.k = (a.k + 1) % 72 WHERE a.v > l.v AND a.v > r.v AND a.v > 1.02 * (SELECT avg(v) FROM f)")
def q_peaks(spark, d):
    f = stats.wrapped_density(sites(spark, d).withColumn("arc", geo.arc_position("lat", "lon")), "arc", 72, 8.0).withColumn("k", F.round(F.col("at") / 5.0).cast("int"))
    one = Window.partitionBy(F.lit(0))  # 72 grid points
    w = one.orderBy("k")
    left = F.coalesce(F.lag("density").over(w), F.max_by("density", "k").over(one))
    right = F.coalesce(F.lead("density").over(w), F.min_by("density", "k").over(one))
    return f.withColumns({"l": left, "r": right, "m": F.avg("density").over(one)}).where("density > l and density > r and density > 1.02 * m").select("at", r6("density").alias("density"))


@query("nearest_raster_cell", f"WITH {SITES}, grid AS (SELECT a.range AS row, b.range AS col, ((a.range * 37 + b.range * 91) % 1000) / 10.0 AS value FROM range(37) a, range(72) b), p AS (SELECT id, round_even((90.0 - lat) / 5.0, 0) AS r, round_even((lon + 180.0) / 5.0, 0)::BIGINT % 72 AS c FROM sites) SELECT p.id, value FROM p JOIN grid ON row = r AND col = c")
def q_cell(spark, d):
    from arcspan.operators import raster
    from arcspan.plans.reference_stats import _grid

    return raster.nearest_cell(sites(spark, d), _grid(spark), 5.0).select("id", "value")


@query("monotone_gradient", f"WITH {SITES}, c AS (SELECT nation % 5 AS step, count(*) AS n, count(*) FILTER (WHERE {circle()} <= 500) AS o FROM sites GROUP BY 1), z AS (SELECT step, (o - n * sin(500 / 6371.0)) / sqrt(n * sin(500 / 6371.0)) AS z FROM c), l AS (SELECT step, z, lag(z) OVER (ORDER BY step) AS p FROM z) SELECT count(*) AS steps, bool_and(p IS NULL OR z <= p) AS falling, round(max(z) - min(z), 6) AS span FROM l")
def q_monotone(spark, d):
    c = sites(spark, d).groupBy((F.col("nation") % 5).alias("step")).agg(F.count("*").alias("n"), F.count_if(circle_km("lat", "lon") <= 500).alias("o"))
    e = F.col("n") * math.sin(500 / 6371.0)
    z = c.withColumn("z", (F.col("o") - e) / F.sqrt(e)).withColumn("p", F.lag("z").over(Window.partitionBy(F.lit(0)).orderBy("step")))
    return z.agg(F.count("*").alias("steps"), F.bool_and(F.col("p").isNull() | (F.col("z") <= F.col("p"))).alias("falling"), r6(F.max("z") - F.min("z")).alias("span"))


@query("precession", "SELECT c_custkey AS id, round((((c_custkey % 360) + c_nationkey * 100 * 50.29::DOUBLE / 3600.0) % 360), 6) AS lon FROM customer")
def q_precession(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), r6(geo.precessed_lon(F.col("c_custkey") % 360, F.col("c_nationkey") * 100)).alias("lon"))


@query("fit_random_sites")
def q_fit_random(spark, d):
    """Circles fitted to 15 drawn sites, 200 times, and the sites within 50 km of each."""
    from arcspan.operators import fit

    s = sites(spark, d).select(F.col("id").alias("row"), "lat", "lon")
    f = fit.fitted_to_draws(s, s.count(), 200, 15, 50.0)
    return f.select("trial", r6("pole_lat", 4).alias("pole_lat"), r6("pole_lon", 4).alias("pole_lon"), r6("rms_km", 3).alias("rms_km"), "n")


_TRY = lambda seed: nulls.uniform_sql(seed, "trial", "attempt")


@query("latitude_matched_poles", f"WITH {SITES}, t AS (SELECT min(lat) AS low, max(lat) AS high FROM sites WHERE {circle()} <= 500 AND lat > 0), g AS (SELECT a.range AS trial, b.range AS attempt FROM range(200) a, range(51) b), p AS (SELECT trial, attempt, degrees(asin(2.0 * {_TRY(5)} - 1.0)) AS lat, 360.0 * {_TRY(6)} - 180.0 AS lon FROM g), o AS (SELECT trial, attempt, lat, lon, attempt = 50 OR least(90 - abs(lat), high) - greatest(abs(lat) - 90, low) >= 0.5 * (high - low) AND least(90 - abs(lat), high) > greatest(abs(lat) - 90, low) AS ok FROM p, t), k AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY attempt) AS rn FROM o WHERE ok) SELECT trial, attempt, round(lat, 6) AS lat, round(lon, 6) AS lon FROM k WHERE rn = 1")
def q_latitude_matched(spark, d):
    """Random circles whose range of latitudes overlaps that of the sites near the default circle north of the equator by half of theirs at least."""
    low, high = sites(spark, d).where((circle_km("lat", "lon") <= 500) & (F.col("lat") > 0)).agg(F.min("lat"), F.max("lat")).first()
    return nulls.latitude_matched_poles(spark, 200, low, high, 50, 5).select("trial", "attempt", r6("lat").alias("lat"), r6("lon").alias("lon"))
