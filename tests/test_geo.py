import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcspan.functions import geo
from arcspan.operators.spatial import haversine_np, reach_boxes

import numpy as np


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_known_distances(spark):
    r = one(spark, khufu=geo.circle_km(29.9792, 31.1342), khafre=geo.circle_km(29.9761, 31.1308), equator=geo.haversine_km(0.0, 0.0, 0.0, 180.0), same=geo.haversine_km(5.0, 5.0, 5.0, 5.0))
    assert r["khufu"] == pytest.approx(6.538312657898132, abs=1e-9)
    assert r["khafre"] == pytest.approx(6.224329514619967, abs=1e-9)
    assert r["equator"] == pytest.approx(math.pi * 6371.0)
    assert r["same"] == 0.0


def test_circle_points(spark):
    rows = {r["id"]: r for r in spark.range(360).select("id", geo.point_lat(F.col("id")).alias("lat"), geo.point_lon(F.col("id")).alias("lon")).collect()}
    for b, lat, lon in ((0, 30.317878, 41.353913), (1, 30.312775, 40.195524), (2, 30.29747, 39.037377), (178, -30.29747, -136.329551), (180, -30.317878, -138.646087)):
        assert rows[b]["lat"] == pytest.approx(lat, abs=1e-5)
        assert (rows[b]["lon"] - lon) % 360 == pytest.approx(0, abs=1e-5) or (rows[b]["lon"] - lon) % 360 == pytest.approx(360, abs=1e-5)


def test_points_of_the_circle_lie_on_it(spark):
    d = spark.range(360).select(geo.circle_km(geo.point_lat(F.col("id")), geo.point_lon(F.col("id"))).alias("d")).agg(F.max("d")).first()[0]
    assert d < 1e-6


def test_antipodal_poles_have_one_circle(spark):
    r = one(spark, a=geo.circle_km(12.0, 34.0), b=geo.circle_km(12.0, 34.0, -geo.DEFAULT_POLE[0], geo.DEFAULT_POLE[1] + 180))
    assert r["a"] == pytest.approx(r["b"], abs=1e-8)


def test_angles_and_nulls(spark):
    r = one(spark, s=geo.signed_angle(350.0, 10.0), b=geo.angle_between(350.0, 10.0), x=geo.axial_angle(0.0, 170.0), w=geo.wrap_lon(190.0), n=geo.circle_km(F.lit(None).cast("double"), 3.0), up=geo.sunrise_azimuth(80.0))
    assert (r["s"], r["b"], r["x"], r["w"]) == pytest.approx((-20.0, 20.0, 10.0, -170.0)) and r["n"] is None and r["up"] is None


def test_crossing_lies_on_circle(spark):
    meets, lat, lon = geo.segment_crossing(60.0, 10.0, -60.0, 20.0)
    r = spark.range(1).select(meets.alias("m"), geo.circle_km(lat, lon).alias("d")).first()
    assert r["m"] and r["d"] < 1e-6
    near_lat, near_lon = geo.nearest_on_circle(45.0, 12.0)
    r = spark.range(1).select(geo.circle_km(near_lat, near_lon).alias("d"), geo.haversine_km(45.0, 12.0, near_lat, near_lon).alias("h"), geo.circle_km(45.0, 12.0).alias("c")).first()
    assert r["d"] < 1e-6 and r["h"] == pytest.approx(r["c"], abs=1e-6)


@settings(max_examples=200, deadline=None)
@given(st.floats(-90, 90), st.floats(-180, 179.99), st.floats(0.1, 3000), st.floats(0, 360), st.floats(0, 0.999))
def test_boxes_hold_what_is_near(lat, lon, km, course, share):
    d, b, la = share * km / 6371.0, math.radians(course), math.radians(lat)
    to_lat = math.asin(max(-1, min(1, math.sin(la) * math.cos(d) + math.cos(la) * math.sin(d) * math.cos(b))))
    to_lon = math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(la), math.cos(d) - math.sin(la) * math.sin(to_lat))
    y, x = math.degrees(to_lat), (math.degrees(to_lon) + 180) % 360 - 180
    if haversine_np(lat, lon, y, x) > km:
        return
    boxes, _ = reach_boxes(np.array([lat]), np.array([lon]), km)
    assert any(a <= x <= c and s <= y <= n for a, s, c, n in boxes)
