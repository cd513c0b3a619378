"""SQL for the same expressions, as DuckDB takes it."""

from __future__ import annotations

import math

from arcspan.functions.geo import DEFAULT_POLE, EARTH_RADIUS_KM, QUARTER_KM

SITES = """sites AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 18001) / 100.0 - 90.0 AS lat, ((c_custkey * 104729) % 36001) / 100.0 - 180.0 AS lon,
 c_mktsegment AS type, c_nationkey AS nation, c_acctbal AS bal, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'monument' WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'settlement' ELSE 'other' END AS cls FROM customer)"""
SITES2 = """sites2 AS (SELECT s_suppkey AS id, ((s_suppkey * 245489) % 18001) / 100.0 - 90.0 AS lat, ((s_suppkey * 1780393) % 36001) / 100.0 - 180.0 AS lon FROM supplier)"""


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"({2 * EARTH_RADIUS_KM} * asin(sqrt(least(1.0, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)))))"


def circle(lat: str = "lat", lon: str = "lon", pole=DEFAULT_POLE) -> str:
    return f"abs({hav(lat, lon, str(pole[0]), str(pole[1]))} - {QUARTER_KM!r})"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    y = f"sin(radians(({lon2}) - ({lon1}))) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians(({lon2}) - ({lon1})))"
    return f"(((degrees(atan2({y}, {x})) % 360) + 360) % 360)"


def wrap(x: str) -> str:
    return f"((((({x}) + 180.0) % 360) + 360) % 360 - 180.0)"


PI = f"{math.pi!r}::DOUBLE"
