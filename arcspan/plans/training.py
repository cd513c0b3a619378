"""Queries p1, p3 and p4 over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.operators.multivalue import split_values
from arcspan.operators.spatial import near_join, region_join
from arcspan.operators.units import BP, CALENDAR, standard_values, stated_units
from arcspan.plans.runtime import not_blank, table
from arcspan.plans.sqltext import hav, wrap


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with a date row at most 2 km from each place, and the study areas that hold it."""
    places = table(spark, sf_dir, "pleiades_places_latest").select("id", "reprLat", "reprLong")
    dates = table(spark, sf_dir, "p3k14c_data").where(not_blank("SiteID")).select("SiteID", "Lat", "Long")
    areas = table(spark, sf_dir, "study_areas")
    near = near_join(places, dates, "id", "SiteID", 2.0, "reprLat", "reprLong", "Lat", "Long")
    inside = region_join(places, areas, "id", "area_code", "ring_no", "vertex_no", "reprLat", "reprLong")
    one = near.select(F.col("place_key").alias("place_id"), F.lit("near").alias("match_kind"), F.col("site_key").alias("match_key"))
    return one.unionByName(inside.select(F.col("place_key").alias("place_id"), F.lit("inside").alias("match_kind"), F.col("region_key").alias("match_key")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages in years BP and earliest dates in signed calendar years, where they were written otherwise."""
    sources = stated_units(table(spark, sf_dir, "date_sources"), "source_code", "remark")
    ages = standard_values(table(spark, sf_dir, "p3k14c_data"), "rec_id", "Age", "Notes", "Source", BP, sources)
    years = standard_values(table(spark, sf_dir, "pleiades_places_latest"), "id", "minDate", "description", None, CALENDAR)
    return ages.select(F.lit("p3k14c_data").alias("src_table"), "rec_key", "std_value").unionByName(years.select(F.lit("pleiades_places_latest").alias("src_table"), "rec_key", "std_value"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature types of the gazetteer, one row each with its position."""
    return split_values(table(spark, sf_dir, "pleiades_places_latest"), "id", "featureTypes").withColumnRenamed("id", "place_id")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found}

_USABLE = "{lat} IS NOT NULL AND NOT isnan({lat}) AND {lon} IS NOT NULL AND NOT isnan({lon}) AND abs({lat}) <= 90 AND NOT ({lat} = 0 AND {lon} = 0)"
_PLACES = f"p AS (SELECT DISTINCT id, reprLat AS lat, {wrap('reprLong')} AS lon FROM pleiades_places_latest WHERE {_USABLE.format(lat='reprLat', lon='reprLong')})"
_SITES = f"s AS (SELECT DISTINCT SiteID, Lat AS lat, {wrap('Long')} AS lon FROM p3k14c_data WHERE trim(SiteID) <> '' AND {_USABLE.format(lat='Lat', lon='Long')})"
ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {_PLACES}, {_SITES}, e AS (SELECT area_code, lat AS y1, lon AS x1, coalesce(lead(lat) OVER w, first(lat) OVER w) AS y2, coalesce(lead(lon) OVER w, first(lon) OVER w) AS x2 FROM study_areas WINDOW w AS (PARTITION BY area_code, ring_no ORDER BY vertex_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t AS (SELECT unnest([-360.0, 0.0, 360.0])::DOUBLE AS turn), c AS (SELECT p.id, e.area_code, t.turn, count(*) FILTER (WHERE (y1 <= p.lat) <> (y2 <= p.lat) AND p.lon + turn < (x2 - x1) * (p.lat - y1) / (y2 - y1) + x1) AS crossings FROM p, t, e GROUP BY ALL)
SELECT DISTINCT p.id AS place_id, 'near' AS match_kind, s.SiteID AS match_key FROM p JOIN s ON s.lat BETWEEN p.lat - 0.02 AND p.lat + 0.02 AND {hav('p.lat', 'p.lon', 's.lat', 's.lon')} <= 2 UNION ALL SELECT DISTINCT id, 'inside', area_code FROM c WHERE crossings % 2 = 1""",
}
