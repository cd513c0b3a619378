"""Spherical geometry as Column expressions, all inside whole-stage codegen. Angles in degrees, lengths in km."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: mean earth radius, pole of the default circle, reference point on it
EARTH_RADIUS_KM = 6371.0
DEFAULT_POLE = (59.682122, -138.646087)
GIZA = (29.9792, 31.1342)

QUARTER_KM = math.pi * EARTH_RADIUS_KM / 2


def col(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def held(c: Column, low: float, high: float) -> Column:
    """c held between two bounds; null stays null, which least() and greatest() would pass over."""
    return F.when(c > high, F.lit(high)).when(c < low, F.lit(low)).otherwise(c)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; the arcsine's argument is held at 1."""
    a1, o1, a2, o2 = map(col, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(a2 - a1) / 2), 2) + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * F.pow(F.sin(F.radians(o2 - o1) / 2), 2)
    return F.asin(F.sqrt(held(h, 0.0, 1.0))) * (2 * EARTH_RADIUS_KM)


def angular_separation(lat1, lon1, lat2, lon2) -> Column:
    """Degrees between two points by the cosine rule; less exact than haversine for close points."""
    a1, o1, a2, o2 = (F.radians(col(v)) for v in (lat1, lon1, lat2, lon2))
    c = F.sin(a1) * F.sin(a2) + F.cos(a1) * F.cos(a2) * F.cos(o2 - o1)
    return F.degrees(F.acos(held(c, -1.0, 1.0)))


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    """Flat approximation at 111 km a degree, longitudes shrunk at the first latitude."""
    a1, o1, a2, o2 = map(col, (lat1, lon1, lat2, lon2))
    return F.sqrt(F.pow((o2 - o1) * F.cos(F.radians(a1)), 2) + F.pow(a2 - a1, 2)) * 111.0


def circle_km(lat, lon, pole_lat=DEFAULT_POLE[0], pole_lon=DEFAULT_POLE[1]) -> Column:
    """Distance to the great circle with that pole."""
    return F.abs(haversine_km(lat, lon, pole_lat, pole_lon) - QUARTER_KM)


def unit_x(lat, lon) -> Column:
    return F.cos(F.radians(col(lat))) * F.cos(F.radians(col(lon)))


def unit_y(lat, lon) -> Column:
    return F.cos(F.radians(col(lat))) * F.sin(F.radians(col(lon)))


def unit_z(lat) -> Column:
    return F.sin(F.radians(col(lat)))


def band_sine(km: float) -> float:
    """|s.p| at most this is the same as lying within km of the circle with pole p."""
    return math.sin(km / EARTH_RADIUS_KM)


def wrap_lon(lon) -> Column:
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    a1, o1, a2, o2 = (F.radians(col(v)) for v in (lat1, lon1, lat2, lon2))
    y = F.sin(o2 - o1) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(o2 - o1)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def tangent_bearing(lat, lon, pole_lat=DEFAULT_POLE[0], pole_lon=DEFAULT_POLE[1]) -> Column:
    """Direction of the circle where it passes: bearing to the pole plus 90."""
    return F.pmod(bearing(lat, lon, pole_lat, pole_lon) + 90.0, F.lit(360.0))


def signed_angle(a, b) -> Column:
    """a - b in [-180, 180)."""
    return F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0


def angle_between(a, b) -> Column:
    """0 to 180."""
    return F.abs(signed_angle(a, b))


def axial_angle(a, b) -> Column:
    """0 to 90, of undirected axes."""
    d = angle_between(a, b)
    return F.least(d, F.lit(180.0) - d)


def point_lat(bearing_deg, pole_lat=DEFAULT_POLE[0]) -> Column:
    """Latitude of the point of the circle at a bearing from its pole."""
    return F.degrees(F.asin(F.cos(F.radians(col(pole_lat))) * F.cos(F.radians(col(bearing_deg)))))


def point_lon(bearing_deg, pole_lat=DEFAULT_POLE[0], pole_lon=DEFAULT_POLE[1], wrapped: bool = False) -> Column:
    """Its longitude, on request wrapped into [-180, 180)."""
    b, p = F.radians(col(bearing_deg)), F.radians(col(pole_lat))
    la = F.radians(point_lat(bearing_deg, pole_lat))
    lon = col(pole_lon) + F.degrees(F.atan2(F.sin(b) * F.cos(p), -F.sin(p) * F.sin(la)))
    return wrap_lon(lon) if wrapped else lon


def _frame(pole: tuple[float, float], origin: tuple[float, float]) -> tuple[list[float], list[float], list[float]]:
    """Orthonormal n, u, v: the pole, the circle's point nearest to the origin, and 90 degrees on."""

    def vector(p):
        la, lo = math.radians(p[0]), math.radians(p[1])
        return [math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)]

    n, o = vector(pole), vector(origin)
    dot = sum(a * b for a, b in zip(n, o))
    u = [b - dot * a for a, b in zip(n, o)]
    size = math.sqrt(sum(a * a for a in u))
    u = [a / size for a in u]
    return n, u, [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]


def arc_position(lat, lon, pole=DEFAULT_POLE, origin: tuple[float, float] = GIZA) -> Column:
    """Degrees along the circle from the point of it nearest to the origin, 0 to 360."""
    _, u, v = _frame(pole, origin)
    x, y, z = unit_x(lat, lon), unit_y(lat, lon), unit_z(lat)
    return F.pmod(F.degrees(F.atan2(x * v[0] + y * v[1] + z * v[2], x * u[0] + y * u[1] + z * u[2])), F.lit(360.0))


def pole_bearing(lat, lon, pole=DEFAULT_POLE) -> Column:
    """Position along the circle counted from the pole's north."""
    return bearing(pole[0], pole[1], lat, lon)


def along_km(lat, lon, pole=DEFAULT_POLE, origin: tuple[float, float] = GIZA) -> Column:
    """Signed length along the circle from the origin's foot point, the shorter way."""
    return F.radians(signed_angle(arc_position(lat, lon, pole, origin), 0.0)) * EARTH_RADIUS_KM


def perp_km(lat, lon, pole=DEFAULT_POLE) -> Column:
    """Signed distance from the circle, positive on the pole's side."""
    return QUARTER_KM - haversine_km(lat, lon, pole[0], pole[1])


def cross_track_km(lat, lon, centre_lat: float, centre_lon: float, course: float) -> Column:
    """Signed distance from the great circle through a centre on a course; positive to its right."""
    d = haversine_km(centre_lat, centre_lon, lat, lon) / EARTH_RADIUS_KM
    turn = F.radians(bearing(centre_lat, centre_lon, lat, lon) - course)
    return F.asin(held(F.sin(d) * F.sin(turn), -1.0, 1.0)) * EARTH_RADIUS_KM


def nearest_on_circle(lat, lon, pole=DEFAULT_POLE) -> tuple[Column, Column]:
    """Latitude and longitude of the circle's point nearest to a point: the vector less its part along the pole."""
    n = _frame(pole, (0.0, 0.0))[0]
    x, y, z = unit_x(lat, lon), unit_y(lat, lon), unit_z(lat)
    dot = x * n[0] + y * n[1] + z * n[2]
    rx, ry, rz = x - dot * n[0], y - dot * n[1], z - dot * n[2]
    return F.degrees(F.atan2(rz, F.sqrt(rx * rx + ry * ry))), F.degrees(F.atan2(ry, rx))


def segment_crossing(lat1, lon1, lat2, lon2, pole=DEFAULT_POLE) -> tuple[Column, Column, Column]:
    """Whether a great-circle segment meets the circle, and where (null if not), in closed form.

    The crossing point divides the chord in the ratio of the ends' heights over the circle's plane.
    """
    n = _frame(pole, (0.0, 0.0))[0]
    a = (unit_x(lat1, lon1), unit_y(lat1, lon1), unit_z(lat1))
    b = (unit_x(lat2, lon2), unit_y(lat2, lon2), unit_z(lat2))
    ha, hb = (p[0] * n[0] + p[1] * n[1] + p[2] * n[2] for p in (a, b))
    meets = (ha * hb <= 0) & (ha != hb)
    x, y, z = (F.when(meets, p * hb - q * ha) * F.when(hb >= ha, F.lit(1.0)).otherwise(F.lit(-1.0)) for p, q in zip(a, b))
    return meets, F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def collinearity(lat1, lon1, lat2, lon2, lat3, lon3) -> Column:
    """Largest inner angle of the flat triangle of three points; 180 for points in a line, null for coinciding ones."""
    p = [(col(a), col(o)) for a, o in ((lat1, lon1), (lat2, lon2), (lat3, lon3))]

    def angle(i: int, j: int, k: int) -> Column:
        ux, uy, vx, vy = p[j][1] - p[i][1], p[j][0] - p[i][0], p[k][1] - p[i][1], p[k][0] - p[i][0]
        size = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
        return F.degrees(F.acos(held(F.try_divide(ux * vx + uy * vy, size), -1.0, 1.0)))

    return F.greatest(angle(0, 1, 2), angle(1, 0, 2), angle(2, 0, 1))


def sunrise_azimuth(lat, declination: float = 23.44) -> Column:
    """Azimuth of the rising sun for a declination; null where it does not rise."""
    c = math.sin(math.radians(declination)) / F.cos(F.radians(col(lat)))
    return F.when(F.abs(c) <= 1, F.degrees(F.acos(c)))


def offset_toward_pole(lat, lon, share, pole=DEFAULT_POLE) -> tuple[Column, Column]:
    """A point moved by a share of its way to the pole, straight in degrees of latitude and longitude."""
    la, lo, s = col(lat), col(lon), col(share)
    return la + (F.lit(float(pole[0])) - la) * s, lo + signed_angle(pole[1], lo) * s


def midpoint(lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """The middle in degrees, not on the sphere."""
    return (col(lat1) + col(lat2)) / 2, (col(lon1) + col(lon2)) / 2


def along_across(km, course, lat, lon, pole=DEFAULT_POLE) -> tuple[Column, Column]:
    """The parts of a move along the circle's direction at its start and across it."""
    turn = F.radians(signed_angle(course, tangent_bearing(lat, lon, *pole)))
    return F.abs(col(km) * F.cos(turn)), F.abs(col(km) * F.sin(turn))


def precessed_lon(ecliptic_lon, years, rate: float = 50.29 / 3600.0) -> Column:
    """Ecliptic longitude after linear precession of 50.29 seconds of arc a year."""
    return F.pmod(col(ecliptic_lon) + col(years) * rate, F.lit(360.0))


def rising_azimuth(lat, declination) -> Column:
    """Azimuth at which a body of a declination rises; null where it never does."""
    c = F.sin(F.radians(col(declination))) / F.cos(F.radians(col(lat)))
    return F.when(F.abs(c) <= 1, F.degrees(F.acos(c)))


def mutual_inclination(pole1_lat, pole1_lon, pole2_lat, pole2_lon) -> Column:
    """Angle between two great circles, 0 to 90."""
    d = angular_separation(pole1_lat, pole1_lon, pole2_lat, pole2_lon)
    return F.least(d, F.lit(180.0) - d)


def frame_point(angle_deg, pole=DEFAULT_POLE, origin: tuple[float, float] = GIZA) -> tuple[Column, Column]:
    """Latitude and longitude of the circle's point at an angle from its point nearest to the origin."""
    _, u, v = _frame(pole, origin)
    c, s = F.cos(F.radians(col(angle_deg))), F.sin(F.radians(col(angle_deg)))
    x, y, z = (c * a + s * b for a, b in zip(u, v))
    return F.degrees(F.asin(held(z, -1.0, 1.0))), F.degrees(F.atan2(y, x))


def along_pole_km(lat, lon, pole: tuple[float, float] = DEFAULT_POLE) -> Column:
    """Distance along the equator of a pole: the signed bearing from the pole, as an arc of the earth's radius."""
    b = bearing(F.lit(pole[0]), F.lit(pole[1]), lat, lon)
    return F.radians(F.pmod(b + 180.0, F.lit(360.0)) - 180.0) * EARTH_RADIUS_KM


def pole_through(lat, lon, lat2: float, lon2: float) -> tuple[Column, Column]:
    """Northern pole of the circle through a point and a fixed one; null where both are one or antipodal."""
    x, y, z = unit_x(lat, lon), unit_y(lat, lon), unit_z(lat)
    gx, gy, gz = math.cos(math.radians(lat2)) * math.cos(math.radians(lon2)), math.cos(math.radians(lat2)) * math.sin(math.radians(lon2)), math.sin(math.radians(lat2))
    nx, ny, nz = y * gz - z * gy, z * gx - x * gz, x * gy - y * gx
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    sign = F.when(nz < 0, -1.0).otherwise(1.0)
    return F.when(size > 1e-12, F.degrees(F.asin(F.abs(nz) / size))), F.when(size > 1e-12, F.degrees(F.atan2(ny * sign, nx * sign)))
