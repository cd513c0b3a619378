"""Queries of the corridor and point-pattern operators over the star-schema tables and the two gazetteers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcspan.functions import classify, dates, geo
from arcspan.functions.geo import band_sine, circle_km, haversine_km
from arcspan.operators import dedup, joins, nulls, poles, windows
from arcspan.plans.runtime import not_blank, table
from arcspan.plans.sqltext import PI, SITES, bearing, circle, hav, wrap

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
THRESHOLDS = [25.0, 50.0, 100.0, 200.0, 500.0]
TRIALS = 40


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Customers as points: coordinates by whole-number arithmetic, two classes out of five types."""
    c = table(spark, d, "customer")
    cls = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "monument").when(F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE"), "settlement").otherwise("other")
    return c.select(F.col("c_custkey").alias("id"), (F.pmod(F.col("c_custkey") * 7919, F.lit(18001)) / 100.0 - 90.0).alias("lat"), (F.pmod(F.col("c_custkey") * 104729, F.lit(36001)) / 100.0 - 180.0).alias("lon"), F.col("c_mktsegment").alias("type"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"), cls.alias("cls"))


def sites2(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.pmod(F.col("s_suppkey") * 245489, F.lit(18001)) / 100.0 - 90.0).alias("lat"), (F.pmod(F.col("s_suppkey") * 1780393, F.lit(36001)) / 100.0 - 180.0).alias("lon"))


def r6(c, digits: int = 6):
    return F.round(c, digits)


# --- corridor -----------------------------------------------------------------------------------------------------------

_COUNTS = f"""WITH {SITES}, d AS (SELECT type, {circle()} AS km FROM sites), t AS (SELECT unnest([25.0, 50.0, 100.0, 200.0, 500.0])::DOUBLE AS km),
n AS (SELECT type, t.km, count(*) FILTER (WHERE d.km <= t.km) AS observed, count(*) AS total FROM d, t GROUP BY type, t.km)"""


@query("corridor_counts", _COUNTS + """ SELECT type, km, observed, total, round(total * sin(km / 6371.0), 6) AS expected, round((observed - total * sin(km / 6371.0)) / sqrt(total * sin(km / 6371.0)), 6) AS z FROM n""")
def q_corridor_counts(spark, d):
    s = sites(spark, d)
    counts = nulls.corridor_counts(s, THRESHOLDS, ["type"]).join(s.groupBy("type").agg(F.count("*").alias("total")), "type")
    expected = F.col("total") * F.sin(F.col("km") / 6371.0)
    return counts.select("type", "km", F.col("n").alias("observed"), "total", r6(expected).alias("expected"), r6((F.col("n") - expected) / F.sqrt(expected)).alias("z"))


@query("distance_projection", f"""WITH {SITES} SELECT id, round({circle()}, 6) AS km, round({bearing('lat', 'lon', '59.682122', '-138.646087')}, 6) AS to_pole,
 round(degrees(acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(10.0)) + cos(radians(lat)) * cos(radians(10.0)) * cos(radians(20.0 - lon)))))), 6) AS sep,
 round(sqrt(pow((20.0 - lon) * cos(radians(lat)), 2) + pow(10.0 - lat, 2)) * 111.0, 6) AS planar, round({PI} * 6371.0 / 2 - {hav('lat', 'lon', '59.682122', '-138.646087')}, 6) AS perp FROM sites""")
def q_distance_projection(spark, d):
    return sites(spark, d).select("id", r6(circle_km("lat", "lon")).alias("km"), r6(geo.bearing("lat", "lon", *geo.DEFAULT_POLE)).alias("to_pole"), r6(geo.angular_separation("lat", "lon", 10.0, 20.0)).alias("sep"), r6(geo.planar_km("lat", "lon", 10.0, 20.0)).alias("planar"), r6(geo.perp_km("lat", "lon")).alias("perp"))


def _frame_sql() -> tuple[str, str]:
    n, u, v = geo._frame(geo.DEFAULT_POLE, geo.GIZA)
    x, y, z = "cos(radians(lat)) * cos(radians(lon))", "cos(radians(lat)) * sin(radians(lon))", "sin(radians(lat))"
    dot = lambda w: f"({x} * ({w[0]!r}) + {y} * ({w[1]!r}) + {z} * ({w[2]!r}))"
    return f"(((degrees(atan2({dot(v)}, {dot(u)})) % 360) + 360) % 360)", dot(n)


@query("arc_bins", f"""WITH {SITES} SELECT floor({_frame_sql()[0]} / 10.0) * 10.0 AS arc, count(*) AS n, count(*) FILTER (WHERE {circle()} <= 200) AS near FROM sites GROUP BY 1""")
def q_arc_bins(spark, d):
    return sites(spark, d).groupBy((F.floor(geo.arc_position("lat", "lon") / 10.0) * 10.0).alias("arc")).agg(F.count("*").alias("n"), F.count_if(circle_km("lat", "lon") <= 200).alias("near"))


@query("circle_trace", f"""WITH b AS (SELECT range AS bearing FROM range(360)), p AS (SELECT bearing, degrees(asin(cos(radians(59.682122)) * cos(radians(bearing)))) AS lat FROM b)
SELECT bearing, round(lat, 6) + 0.0 AS lat, round(-138.646087 + degrees(atan2(sin(radians(bearing)) * cos(radians(59.682122)), -sin(radians(59.682122)) * sin(radians(lat)))), 6) AS lon FROM p""")
def q_circle_trace(spark, d):
    return spark.range(360).select(F.col("id").alias("bearing"), r6(geo.point_lat(F.col("id"))).alias("lat"), r6(geo.point_lon(F.col("id"))).alias("lon"))


@query("segment_crossings", f"""WITH {SITES}, s AS (SELECT id, lat, lon, lead(lat) OVER (PARTITION BY nation ORDER BY id) AS lat2, lead(lon) OVER (PARTITION BY nation ORDER BY id) AS lon2 FROM sites),
h AS (SELECT id, {_frame_sql()[1]} AS ha, {_frame_sql()[1].replace('lat', 'lat2').replace('lon', 'lon2')} AS hb FROM s WHERE lat2 IS NOT NULL) SELECT id, ha * hb <= 0 AND ha <> hb AS meets FROM h""")
def q_segment_crossings(spark, d):
    pairs = joins.consecutive(sites(spark, d).select("id", "nation", "lat", "lon"), ["nation"], ["id"], ["lat", "lon"])
    return pairs.select("id", geo.segment_crossing("lat", "lon", "next_lat", "next_lon")[0].alias("meets"))


@query("nearest_topk", f"WITH {SITES} SELECT id, type, round({circle()}, 6) AS km FROM sites WHERE {circle()} <= 500 ORDER BY {circle()}, id LIMIT 50")
def q_nearest_topk(spark, d):
    return sites(spark, d).withColumn("km", circle_km("lat", "lon")).where("km <= 500").orderBy("km", "id").limit(50).select("id", "type", r6("km").alias("km"))


@query("type_enrichment", f"""WITH {SITES}, d AS (SELECT type, {circle()} <= 500 AS near FROM sites), a AS (SELECT count(*) FILTER (WHERE near) / count(*)::DOUBLE AS rate FROM d)
SELECT type, count(*) AS total, count(*) FILTER (WHERE near) AS within, round(100.0 * count(*) FILTER (WHERE near) / count(*), 6) AS pct, round(count(*) FILTER (WHERE near) / (any_value(rate) * count(*)), 6) AS ratio FROM d, a GROUP BY type HAVING count(*) >= 20""")
def q_type_enrichment(spark, d):
    near = sites(spark, d).select("type", (circle_km("lat", "lon") <= 500).alias("near"))
    by = near.groupBy("type").agg(F.count("*").alias("total"), F.count_if("near").alias("within"))
    all_of = Window.partitionBy(F.lit(0))
    rate = F.sum("within").over(all_of) / F.sum("total").over(all_of)
    return by.withColumn("rate", rate).where("total >= 20").select("type", "total", "within", r6(100.0 * F.col("within") / F.col("total")).alias("pct"), r6(F.col("within") / (F.col("rate") * F.col("total"))).alias("ratio"))


BOXES = classify.REGIONS


@query("region_cascade", f"WITH {SITES} SELECT CASE " + " ".join(f"WHEN lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e} THEN '{k}'" for k, s, n, w, e in BOXES) + " ELSE 'Other' END AS region, cls, count(*) AS n FROM sites GROUP BY ALL")
def q_region_cascade(spark, d):
    return sites(spark, d).groupBy(classify.box_class("lat", "lon", BOXES).alias("region"), "cls").agg(F.count("*").alias("n"))


@query("grid_cell_counts", f"WITH {SITES} SELECT floor(lat / 5.0) * 5.0 AS cell_lat, floor(lon / 5.0) * 5.0 AS cell_lon, count(*) AS n, count(DISTINCT type) AS types FROM sites GROUP BY 1, 2")
def q_grid_cell_counts(spark, d):
    la, lo = classify.grid_cell("lat", "lon", 5.0)
    return sites(spark, d).groupBy(la.alias("cell_lat"), lo.alias("cell_lon")).agg(F.count("*").alias("n"), F.countDistinct("type").alias("types"))


@query("settlement_divergence_poisson", f"""WITH {SITES}, c AS (SELECT cls, count(*) AS n, count(*) FILTER (WHERE {circle()} <= 50) AS o FROM sites WHERE cls <> 'other' GROUP BY cls),
z AS (SELECT cls, n, o, (o - n * sin(50.0 / 6371.0)) / sqrt(n * sin(50.0 / 6371.0)) AS z FROM c)
SELECT max(n) FILTER (WHERE cls = 'monument') AS monuments, max(n) FILTER (WHERE cls = 'settlement') AS settlements, round(max(z) FILTER (WHERE cls = 'monument') - max(z) FILTER (WHERE cls = 'settlement'), 6) AS divergence FROM z""")
def q_divergence_poisson(spark, d):
    c = sites(spark, d).where("cls <> 'other'").groupBy("cls").agg(F.count("*").alias("n"), F.count_if(circle_km("lat", "lon") <= 50).alias("o"))
    e = F.col("n") * math.sin(50.0 / 6371.0)
    z = c.withColumn("z", (F.col("o") - e) / F.sqrt(e))
    only = lambda k, v: F.max(F.when(F.col("cls") == k, F.col(v)))
    return z.agg(only("monument", "n").alias("monuments"), only("settlement", "n").alias("settlements"), r6(only("monument", "z") - only("settlement", "z")).alias("divergence"))


@query("on_off_zone", f"WITH {SITES}, d AS (SELECT type, {circle()} AS km FROM sites) SELECT CASE WHEN km < 50 THEN 'on' WHEN km > 200 THEN 'off' END AS zone, type, count(*) AS n FROM d WHERE km < 50 OR km > 200 GROUP BY ALL")
def q_on_off_zone(spark, d):
    return sites(spark, d).select("type", classify.zone(circle_km("lat", "lon")).alias("zone")).where("zone is not null").groupBy("zone", "type").agg(F.count("*").alias("n"))


@query("density_profile", f"""WITH {SITES}, p AS (SELECT range AS bearing, degrees(asin(cos(radians(59.682122)) * cos(radians(range)))) AS plat FROM range(360)),
q AS (SELECT bearing, plat, {wrap('-138.646087 + degrees(atan2(sin(radians(bearing)) * cos(radians(59.682122)), -sin(radians(59.682122)) * sin(radians(plat))))')} AS plon FROM p)
SELECT bearing, count(*) AS n FROM q JOIN sites ON {hav('plat', 'plon', 'lat', 'lon')} <= 250 GROUP BY bearing""")
def q_density_profile(spark, d):
    trace = spark.range(360).select(F.col("id"), geo.point_lat(F.col("id")).alias("lat"), geo.point_lon(F.col("id"), wrapped=True).alias("lon"))
    return joins.near_counts(trace, sites(spark, d), "id", "id", [250.0]).select(F.col("id").alias("bearing"), F.col("n0").alias("n"))


@query("gap_islands", f"""WITH {SITES}, b AS (SELECT DISTINCT type, CAST(floor({_frame_sql()[0]}) AS BIGINT) AS deg FROM sites WHERE {circle()} <= 300), g AS (SELECT type, deg, deg - row_number() OVER (PARTITION BY type ORDER BY deg) AS g FROM b),
r AS (SELECT type, g, min(deg) AS f, max(deg) AS l, count(*) AS s FROM g GROUP BY type, g), w AS (SELECT *, min(f) OVER (PARTITION BY type) = 0 AND max(l) OVER (PARTITION BY type) = 359 AND count(*) OVER (PARTITION BY type) > 1 AS w FROM r)
SELECT type, f AS first, l AS last, s AS size FROM w WHERE NOT (w AND (f = 0 OR l = 359)) UNION ALL SELECT type, max(f), min(l), sum(s)::BIGINT FROM w WHERE w AND (f = 0 OR l = 359) GROUP BY type""")
def q_gap_islands(spark, d):
    near = sites(spark, d).where(circle_km("lat", "lon") <= 300).select("type", F.floor(geo.arc_position("lat", "lon")).cast("long").alias("deg"))
    return windows.islands(near, ["type"], "deg", 360)


@query("gap_sessions", f"WITH {SITES}, o AS (SELECT id, nation, lon, CASE WHEN lon - lag(lon) OVER (PARTITION BY nation ORDER BY lon) >= 5 THEN 1 ELSE 0 END AS f FROM sites), s AS (SELECT nation, lon, sum(f) OVER (PARTITION BY nation ORDER BY lon RANGE UNBOUNDED PRECEDING) AS session FROM o) SELECT nation, session::BIGINT AS session, count(*) AS n, min(lon) AS west, max(lon) AS east FROM s GROUP BY nation, session")
def q_gap_sessions(spark, d):
    return windows.sessions(sites(spark, d), ["nation"], "lon", 5.0).groupBy("nation", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.min("lon").alias("west"), F.max("lon").alias("east"))


# --- gazetteers ---------------------------------------------------------------------------------------------------------

_GAZ = "gaz AS (SELECT id, reprLat AS lat, reprLong AS lon, list_transform(string_split(lower(featureTypes), ','), lambda x: trim(x)) AS types, minDate FROM pleiades_places_latest WHERE reprLat BETWEEN -90 AND 90 AND reprLong BETWEEN -180 AND 180 AND NOT (reprLat = 0 AND reprLong = 0))"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def gazetteer(spark, d):
    t = table(spark, d, "pleiades_places_latest")
    ok = F.col("reprLat").between(-90, 90) & F.col("reprLong").between(-180, 180) & ~((F.col("reprLat") == 0) & (F.col("reprLong") == 0))
    return t.where(ok).select("id", F.col("reprLat").alias("lat"), F.col("reprLong").alias("lon"), classify.type_set("featureTypes").alias("types"), "minDate")


@query("gazetteer_classes", f"WITH {_GAZ}, c AS (SELECT CASE WHEN list_has_any(types, {_LIST(classify.MONUMENTAL)}) AND list_has_any(types, {_LIST(classify.SETTLEMENT)}) THEN 'both' WHEN list_has_any(types, {_LIST(classify.MONUMENTAL)}) THEN 'monument' WHEN list_has_any(types, {_LIST(classify.SETTLEMENT)}) THEN 'settlement' ELSE 'other' END AS cls, {circle()} AS km FROM gaz) SELECT cls, count(*) AS n, count(*) FILTER (WHERE km <= 50) AS near50, count(*) FILTER (WHERE km < 200) AS near200 FROM c GROUP BY cls")
def q_gazetteer_classes(spark, d):
    g = gazetteer(spark, d).select(classify.set_class(F.col("types"), both=True).alias("cls"), circle_km("lat", "lon").alias("km"))
    return g.groupBy("cls").agg(F.count("*").alias("n"), F.count_if(F.col("km") <= 50).alias("near50"), F.count_if(F.col("km") < 200).alias("near200"))


_DATES = "dates AS (SELECT SiteID, Lat AS lat, Long AS lon, TRY_CAST(Age AS DOUBLE) AS age, Continent FROM p3k14c_data WHERE Lat BETWEEN -90 AND 90 AND Long BETWEEN -180 AND 180 AND NOT (Lat = 0 AND Long = 0))"


def radiocarbon(spark, d):
    t = table(spark, d, "p3k14c_data")
    ok = F.col("Lat").between(-90, 90) & F.col("Long").between(-180, 180) & ~((F.col("Lat") == 0) & (F.col("Long") == 0))
    return t.where(ok).select("SiteID", F.col("Lat").alias("lat"), F.col("Long").alias("lon"), F.expr("try_cast(Age AS DOUBLE)").alias("age"), "Continent")


_CAL1 = lambda a: f"CASE WHEN {a} <= 0 THEN 1950.0 WHEN {a} < 2500 THEN 1950 - {a} WHEN {a} < 5000 THEN 1950 - ({a} * 1.05::DOUBLE + 50) WHEN {a} < 8000 THEN 1950 - ({a} * 1.08::DOUBLE + 100) WHEN {a} < 12000 THEN 1950 - ({a} * 1.12::DOUBLE + 200) ELSE 1950 - ({a} * 1.15::DOUBLE + 300) END"
_CAL2 = lambda a: f"CASE WHEN {a} <= 2000 THEN 1950 - {a} WHEN {a} <= 5000 THEN 1950 - ({a} * 1.05::DOUBLE - 100) WHEN {a} <= 10000 THEN 1950 - ({a} * 1.08::DOUBLE - 250) ELSE 1950 - ({a} * 1.10::DOUBLE - 450) END"


@query("c14_breakpoints", f"WITH a AS (SELECT unnest([-50, 0, 1, 2000, 2499, 2500, 2501, 4999, 5000, 5001, 7999, 8000, 10000, 10001, 11999, 12000, 50000])::DOUBLE AS age) SELECT age, round({_CAL1('age')}, 6) AS y1, round({_CAL2('age')}, 6) AS y2 FROM a")
def q_c14_breakpoints(spark, d):
    a = spark.createDataFrame([(float(x),) for x in (-50, 0, 1, 2000, 2499, 2500, 2501, 4999, 5000, 5001, 7999, 8000, 10000, 10001, 11999, 12000, 50000)], "age double")
    return a.select("age", r6(dates.calibrated_year("age")).alias("y1"), r6(dates.calibrated_year("age", 2)).alias("y2"))


@query("c14_calibrate", f"WITH {_DATES}, c AS (SELECT age, {_CAL1('age')} AS y1, {_CAL2('age')} AS y2 FROM dates WHERE age BETWEEN 0 AND 50000) SELECT CAST(floor(y1 / 1000) AS BIGINT) AS millennium, count(*) AS n, round(avg(y2 - y1), 6) AS shift FROM c GROUP BY 1")
def q_c14_calibrate(spark, d):
    y = radiocarbon(spark, d).where("age between 0 and 50000").select(dates.calibrated_year("age").alias("y1"), dates.calibrated_year("age", 2).alias("y2"))
    return y.groupBy(F.floor(F.col("y1") / 1000).alias("millennium")).agg(F.count("*").alias("n"), r6(F.avg(F.col("y2") - F.col("y1"))).alias("shift"))


@query("dedup_site", f"WITH {_DATES} SELECT 'id:' || trim(SiteID) AS site_key, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, max(age) AS oldest, count(*) AS dates FROM dates WHERE trim(SiteID) <> '' GROUP BY 1")
def q_dedup_site(spark, d):
    return dedup.by_site(radiocarbon(spark, d).where(not_blank("SiteID")), "SiteID", "lat", "lon", "age").select("site_key", r6("lat").alias("lat"), r6("lon").alias("lon"), "oldest", "dates")


@query("dedup_round", f"WITH {SITES}, k AS (SELECT *, floor(lat / 2) AS a, floor(lon / 2) AS b FROM sites) SELECT min(id) AS id, count(*) AS copies FROM k GROUP BY a, b")
def q_dedup_round(spark, d):
    s = sites(spark, d).withColumn("one", F.lit(1))
    keys = {"a": F.floor(F.col("lat") / 2), "b": F.floor(F.col("lon") / 2)}
    first = dedup.first_by_key(s, keys, ["id"]).select("a", "b", "id")
    return first.join(s.groupBy(*[e.alias(k) for k, e in keys.items()]).agg(F.count("*").alias("copies")), ["a", "b"]).select("id", "copies")


@query("time_bin_divergence", f"""WITH {_DATES}, s AS (SELECT trim(SiteID) AS k, avg(lat) AS lat, avg(lon) AS lon, max(age) AS age FROM dates WHERE trim(SiteID) <> '' AND age BETWEEN 1 AND 50000 GROUP BY 1), y AS (SELECT *, {_CAL1('age')} AS y FROM s),
b AS (SELECT CAST(floor(y / 500.0) * 500 AS BIGINT) AS bin_start, count(*) AS n, count(*) FILTER (WHERE {circle()} <= 100) AS near FROM y GROUP BY 1) SELECT bin_start, n, near, CASE WHEN n >= 20 THEN round((near - n * sin(100.0 / 6371.0)) / sqrt(n * sin(100.0 / 6371.0)), 6) END AS z FROM b""")
def q_time_bins(spark, d):
    s = dedup.by_site(radiocarbon(spark, d).where(not_blank("SiteID") & F.col("age").between(1, 50000)), "SiteID", "lat", "lon", "age")
    b = s.groupBy((F.floor(dates.calibrated_year("oldest") / 500.0) * 500).cast("long").alias("bin_start")).agg(F.count("*").alias("n"), F.count_if(circle_km("lat", "lon") <= 100).alias("near"))
    e = F.col("n") * math.sin(100.0 / 6371.0)
    return b.select("bin_start", "n", "near", F.when(F.col("n") >= 20, r6((F.col("near") - e) / F.sqrt(e))).alias("z"))


@query("sampling_density", f"WITH {_DATES}, s AS (SELECT trim(SiteID) AS k, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n FROM dates WHERE trim(SiteID) <> '' GROUP BY 1) SELECT {circle()} <= 200 AS near, count(*) AS sites, sum(n)::BIGINT AS dates, round(avg(n), 6) AS mean_dates FROM s GROUP BY 1")
def q_sampling_density(spark, d):
    s = dedup.by_site(radiocarbon(spark, d).where(not_blank("SiteID")), "SiteID", "lat", "lon", "age")
    return s.groupBy((circle_km("lat", "lon") <= 200).alias("near")).agg(F.count("*").alias("sites"), F.sum("dates").alias("dates"), r6(F.avg("dates")).alias("mean_dates"))


@query("continent_strata", f"WITH {_DATES} SELECT Continent AS continent, count(*) AS n, count(*) FILTER (WHERE {circle()} <= 50) AS n50, count(*) FILTER (WHERE {circle()} <= 200) AS n200 FROM dates GROUP BY 1")
def q_continent_strata(spark, d):
    t = radiocarbon(spark, d).select("Continent", circle_km("lat", "lon").alias("km"))
    return t.groupBy(F.col("Continent").alias("continent")).agg(F.count("*").alias("n"), F.count_if(F.col("km") <= 50).alias("n50"), F.count_if(F.col("km") <= 200).alias("n200"))


# --- nulls, trials, poles -----------------------------------------------------------------------------------------------

_ROWS = f"{SITES}, numbered AS (SELECT row_number() OVER (ORDER BY id) - 1 AS row, * FROM sites), n AS (SELECT count(*) AS n FROM sites), slots AS (SELECT range AS trial, row FROM range({TRIALS}), numbered)"


def _null_sql(joint: bool) -> str:
    lon_row = "i" if joint else "j"
    lat = f"greatest(-90.0, least(90.0, a.lat + 2.0 * {nulls.normal_sql(44, 'trial', 'd.row')}))"
    lon = f"greatest(-180.0, least(180.0, b.lon + 2.0 * {nulls.normal_sql(46, 'trial', 'd.row')}))"
    return f"""WITH {_ROWS}, d AS (SELECT trial, row, {nulls.draw_int_sql(42, 'trial', 'row')} % n.n AS i, {nulls.draw_int_sql(49, 'trial', 'row')} % n.n AS j FROM slots, n),
p AS (SELECT trial, {lat} AS lat, {lon} AS lon FROM d JOIN numbered a ON a.row = d.i JOIN numbered b ON b.row = d.{lon_row}), t AS (SELECT unnest([100.0, 500.0])::DOUBLE AS km),
c AS (SELECT trial, t.km, count(*) FILTER (WHERE {circle()} <= t.km) AS n FROM p, t GROUP BY trial, t.km), o AS (SELECT t.km, count(*) FILTER (WHERE {circle()} <= t.km) AS observed FROM sites, t GROUP BY t.km),
s AS (SELECT c.km, any_value(observed) AS observed, avg(n) AS mu, stddev_pop(n) AS sigma, avg((n >= observed)::INT) AS p FROM c JOIN o ON c.km = o.km GROUP BY c.km)
SELECT km, observed, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(CASE WHEN sigma > 1e-12 THEN (observed - mu) / sigma ELSE 0 END, 6) AS z, round(observed / mu, 6) AS enrichment, round(p, 6) AS p FROM s"""


def _null_query(joint: bool):
    def run(spark, d):
        s = nulls.numbered(sites(spark, d).select("id", "lat", "lon"), ["id"]).select("row", "lat", "lon")
        null = nulls.corridor_counts(nulls.matched_points(s, TRIALS, s.count(), joint), [100.0, 500.0], ["trial"])
        observed = nulls.corridor_counts(s.withColumn("all", F.lit(0)), [100.0, 500.0], ["all"]).select("km", "n")
        out = nulls.null_summary(observed, null, ["km"], TRIALS)
        return out.select("km", "observed", *[r6(c).alias(c) for c in ("mu", "sigma", "z", "enrichment", "p")])

    return run


for _name, _joint in (("mc_joint", True), ("mc_marginal", False)):
    query(_name, _null_sql(_joint))(_null_query(_joint))


@query("divergence_permutation", f"""WITH {_ROWS}, l AS (SELECT trial, s.row, {nulls.draw_int_sql(61, 'trial', 's.row')} AS h, cls = 'monument' AS m, {circle()} <= 500 AS near FROM slots s JOIN numbered n ON n.row = s.row WHERE cls <> 'other'),
k AS (SELECT trial, near, row_number() OVER (PARTITION BY trial ORDER BY h, row) AS rk, count(*) FILTER (WHERE m) OVER (PARTITION BY trial) AS nm FROM l)
SELECT trial, round(avg(near::INT) FILTER (WHERE rk <= nm) - avg(near::INT) FILTER (WHERE rk > nm), 6) AS d FROM k GROUP BY trial""")
def q_divergence_permutation(spark, d):
    s = sites(spark, d).where("cls <> 'other'").select(F.col("id").alias("row"), (F.col("cls") == "monument").alias("m"), (circle_km("lat", "lon") <= 500).alias("near"))
    counts = s.agg(F.count_if("m")).first()[0]
    slots = nulls.trials_of(s.select("row", "near"), TRIALS).withColumn("h", nulls.draw_int(61, F.col("trial"), F.col("row")))
    ranked = nulls.rank_within(slots, ["trial"], ["h"], ["row"])
    near = F.col("near").cast("int")
    first = F.col("rank") < counts
    return ranked.groupBy("trial").agg(r6(F.avg(F.when(first, near)) - F.avg(F.when(~first, near))).alias("d"))


_POLES = f"""poles AS (SELECT range AS pole_id, degrees(asin(2.0 * {nulls.uniform_sql(5, 'range', '0')} - 1.0)) AS plat, 360.0 * {nulls.uniform_sql(6, 'range', '0')} - 180.0 AS plon FROM range(200))"""


@query("mc_random_pole", f"""WITH {SITES}, {_POLES}, c AS (SELECT pole_id, count(*) FILTER (WHERE abs({hav('lat', 'lon', 'plat', 'plon')} - {geo.QUARTER_KM!r}) <= 200) AS n FROM sites, poles GROUP BY pole_id), o AS (SELECT count(*) FILTER (WHERE {circle()} <= 200) AS observed FROM sites)
SELECT any_value(observed) AS observed, round(avg(n), 6) AS mu, round(stddev_pop(n), 6) AS sigma, round((any_value(observed) - avg(n)) / stddev_pop(n), 6) AS z, round(avg((n < observed)::INT), 6) AS percentile, round((1 + count(*) FILTER (WHERE n >= observed)) / (count(*) + 1.0), 6) AS p FROM c, o""")
def q_random_pole(spark, d):
    s = sites(spark, d)
    drawn = nulls.random_poles(spark.range(200).select(F.col("id").alias("pole_id")), 5).collect()
    counts = poles.pole_counts(s, [(r["pole_id"], r["lat"], r["lon"]) for r in drawn], 200.0)
    observed = s.agg(F.count_if(circle_km("lat", "lon") <= 200)).first()[0]
    out = counts.agg(F.lit(observed).cast("long").alias("observed"), F.avg("n").alias("mu"), F.stddev_pop("n").alias("sigma"), F.avg((F.col("n") < observed).cast("int")).alias("percentile"), ((1 + F.count_if(F.col("n") >= observed)) / (F.count("*") + 1.0)).alias("p"))
    return out.select("observed", r6("mu").alias("mu"), r6("sigma").alias("sigma"), r6((F.col("observed") - F.col("mu")) / F.col("sigma")).alias("z"), r6("percentile").alias("percentile"), r6("p").alias("p"))


_GRID = "grid AS (SELECT (a.range * 36 + b.range) AS pole_id, a.range * 10.0 AS plat, b.range * 10.0 - 180.0 AS plon FROM range(10) a, range(36) b)"
_DOT = "abs(cos(radians(lat)) * cos(radians(lon)) * cos(radians(plat)) * cos(radians(plon)) + cos(radians(lat)) * sin(radians(lon)) * cos(radians(plat)) * sin(radians(plon)) + sin(radians(lat)) * sin(radians(plat)))"


@query("pole_scan", f"WITH {SITES}, {_GRID} SELECT pole_id, cls, count(*) FILTER (WHERE {_DOT} <= {band_sine(300.0)!r}) AS n FROM sites, grid GROUP BY pole_id, cls")
def q_pole_scan(spark, d):
    return poles.pole_counts(sites(spark, d), poles.pole_grid(10.0), 300.0, "cls").select("pole_id", "cls", "n")


@query("pole_scan_twostage", f"""WITH {SITES}, {_GRID}, c AS (SELECT pole_id, any_value(plat) AS plat, any_value(plon) AS plon, count(*) FILTER (WHERE {_DOT} <= {band_sine(300.0)!r}) AS n FROM sites, grid GROUP BY pole_id), top AS (SELECT * FROM c WHERE n >= 0.9 * (SELECT max(n) FROM c)),
f AS (SELECT top.pole_id * 100 + (a.range + 2) * 10 + b.range + 2 AS pole_id, plat + a.range * 2.0 AS plat, plon + b.range * 2.0 AS plon FROM top, range(-2, 3) a, range(-2, 3) b)
SELECT pole_id, plat AS lat, plon AS lon, count(*) FILTER (WHERE {_DOT} <= {band_sine(300.0)!r}) AS n FROM sites, f GROUP BY pole_id, plat, plon""")
def q_pole_twostage(spark, d):
    s, coarse = sites(spark, d), poles.pole_grid(10.0)
    counts = {r["pole_id"]: r["n"] for r in poles.pole_counts(s, coarse, 300.0).collect()}  # one row a pole of the stated grid
    best = max(counts.values(), default=0)
    fine = [(p * 100 + (a + 2) * 10 + b + 2, la + a * 2.0, lo + b * 2.0) for p, la, lo in coarse if counts.get(p, 0) >= 0.9 * best for a in range(-2, 3) for b in range(-2, 3)]
    at = spark.createDataFrame([(int(p), float(a), float(o)) for p, a, o in fine], "pole_id long, lat double, lon double")
    return poles.pole_counts(s, fine, 300.0).join(F.broadcast(at), "pole_id").select("pole_id", "lat", "lon", "n")


_HALF = nulls.draw_int_sql(71, "split", "id") + " % 2"


@query("split_sample", f"""WITH {SITES}, {_GRID}, h AS (SELECT range AS split, id, lat, lon, {_HALF.replace('split', 'range')} AS half FROM range(5), sites), c AS (SELECT split, half, pole_id, count(*) FILTER (WHERE {_DOT} <= {band_sine(300.0)!r}) AS n FROM h, grid GROUP BY ALL),
b AS (SELECT split, arg_min(pole_id, (-n * 1000000 + pole_id)) AS pole_id, max(n) AS fitted FROM c WHERE half = 0 GROUP BY split) SELECT b.split, b.pole_id, fitted, c.n AS tested FROM b JOIN c ON c.split = b.split AND c.pole_id = b.pole_id AND half = 1""")
def q_split_sample(spark, d):
    s = sites(spark, d).withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    s = s.withColumn("half", F.concat_ws(":", F.col("split").cast("string"), F.pmod(nulls.draw_int(71, F.col("split"), F.col("id")), F.lit(2)).cast("string")))
    part = F.split("cls", ":")
    c = poles.pole_counts(s, poles.pole_grid(10.0), 300.0, "half").select(part[0].cast("long").alias("split"), part[1].cast("int").alias("half"), "pole_id", "n")
    best = c.where("half = 0").groupBy("split").agg(F.min_by("pole_id", F.struct(-F.col("n"), F.col("pole_id"))).alias("pole_id"), F.max("n").alias("fitted"))
    return best.join(c.where("half = 1"), ["split", "pole_id"]).select("split", "pole_id", "fitted", F.col("n").alias("tested"))


#: the reference's own scan: 2 degrees over the whole sphere, 16 380 poles, and 100 splits; too much for a SQL of every pole with every site
FULL_STEP, FULL_SPLITS, FINE_STEP = 2.0, 100, 0.5


@query("pole_scan_full")
def q_pole_scan_full(spark, d):
    """pole_scan over the reference's grid."""
    return poles.pole_counts(sites(spark, d), poles.pole_grid(FULL_STEP, False), 300.0, "cls").select("pole_id", "cls", "n")


@query("pole_scan_twostage_full")
def q_pole_twostage_full(spark, d):
    """Every pole of the half-degree grid within 1 degree, so as far as half way and beyond, of each 2-degree pole with at least 0.9 of the best count."""
    s, coarse = sites(spark, d), poles.pole_grid(FULL_STEP)
    counts = {r["pole_id"]: r["n"] for r in poles.pole_counts(s, coarse, 300.0).collect()}  # one row a pole of the stated grid
    best, steps = max(counts.values(), default=0), round(1.0 / FINE_STEP)
    # steps from the south pole and from 180 degrees west; neighbours share the poles between them
    fine = {(round((la + 90.0) / FINE_STEP) + a, (round((lo + 180.0) / FINE_STEP) + b) % round(360.0 / FINE_STEP)) for p, la, lo in coarse if counts.get(p, 0) >= 0.9 * best for a in range(-steps, steps + 1) for b in range(-steps, steps + 1)}
    fine = [(i * 1000 + j, i * FINE_STEP - 90.0, j * FINE_STEP - 180.0) for i, j in sorted(fine) if i * FINE_STEP <= 180.0]
    at = spark.createDataFrame(fine, "pole_id long, lat double, lon double")
    return poles.pole_counts(s, fine, 300.0).join(at, "pole_id").select("pole_id", "lat", "lon", "n")


@query("split_sample_full")
def q_split_sample_full(spark, d):
    """split_sample over the reference's grid and number of splits."""
    half = lambda k: F.pmod(nulls.draw_int(71, k, F.col("id")), F.lit(2))
    s = sites(spark, d).withColumn("halves", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(FULL_SPLITS - 1).cast("long")), half))
    c = poles.split_counts(s, poles.pole_grid(FULL_STEP, False), 300.0, "halves")
    first = F.struct(-F.col("fitted"), F.col("pole_id"))
    return c.groupBy("split").agg(F.min_by("pole_id", first).alias("pole_id"), F.max("fitted").alias("fitted"), F.min_by("tested", first).alias("tested"))


@query("loo_cluster", f"""WITH {SITES}, c(cluster, clat, clon) AS (VALUES ('giza', 29.9792, 31.1342), ('nazca', -14.7, -75.1), ('rapanui', -27.1, -109.3)) SELECT cluster, count(*) AS n, count(*) FILTER (WHERE {circle()} <= 200) AS near FROM c, sites WHERE {hav('lat', 'lon', 'clat', 'clon')} > 500 GROUP BY cluster""")
def q_loo_cluster(spark, d):
    s = sites(spark, d).withColumn("km", circle_km("lat", "lon"))
    left = F.array(*[F.when(haversine_km("lat", "lon", a, o) > 500, F.lit(k)) for k, a, o in (("giza", 29.9792, 31.1342), ("nazca", -14.7, -75.1), ("rapanui", -27.1, -109.3))])
    return s.select("km", F.explode(F.array_compact(left)).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("km") <= 200).alias("near"))


@query("bootstrap_ratio", f"""WITH {SITES}, g AS (SELECT bal, {circle()} <= 1000 AS near, row_number() OVER (PARTITION BY {circle()} <= 1000 ORDER BY id) - 1 AS row, count(*) OVER (PARTITION BY {circle()} <= 1000) AS n FROM sites), d AS (SELECT near, trial.range AS trial, {nulls.draw_int_sql(83, 'trial.range', 'g.row')} % n AS i FROM g, range({TRIALS}) trial),
m AS (SELECT trial, median(g.bal) FILTER (WHERE g.near) AS a, median(g.bal) FILTER (WHERE NOT g.near) AS b FROM d JOIN g ON g.near = d.near AND g.row = d.i GROUP BY trial) SELECT round(quantile_cont(a / b, 0.025), 6) AS low, round(quantile_cont(a / b, 0.5), 6) AS middle, round(quantile_cont(a / b, 0.975), 6) AS high FROM m WHERE b > 0""")
def q_bootstrap(spark, d):
    """Interval of the ratio of medians near to and far from the circle, both sides drawn anew with replacement."""
    from arcspan.operators.ranking import rank_within

    s = rank_within(sites(spark, d).select("id", "bal", (circle_km("lat", "lon") <= 1000).alias("near")), ["near"], ["id"], ["id"], "row")
    sizes = {r["near"]: r["n"] for r in s.groupBy("near").agg(F.count("*").alias("n")).collect()}
    n = F.when(F.col("near"), F.lit(sizes.get(True, 1))).otherwise(F.lit(sizes.get(False, 1)))
    drawn = nulls.trials_of(s.select("near", F.col("row").alias("slot")), TRIALS).withColumn("row", F.pmod(nulls.draw_int(83, F.col("trial"), F.col("slot")), n))
    r = drawn.join(s, ["near", "row"]).groupBy("trial").agg(F.percentile(F.when(F.col("near"), F.col("bal")), 0.5).alias("a"), F.percentile(F.when(~F.col("near"), F.col("bal")), 0.5).alias("b"))
    r = r.where("b > 0").select((F.col("a") / F.col("b")).alias("r"))
    return r.agg(*[r6(F.percentile("r", q)).alias(k) for k, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))])
