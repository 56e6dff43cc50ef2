"""Distances, directions, polygons and a planar hexagon grid, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0

# Points of the ring road (lat, lon), in order.
RING = [
    (55.880829, 37.442726), (55.908630, 37.576799), (55.896677, 37.647310), (55.880013, 37.731544), (55.818116, 37.829557),
    (55.779645, 37.842390), (55.710884, 37.838127), (55.700, 37.850), (55.654, 37.850), (55.630, 37.830), (55.575329, 37.688232),
    (55.576377, 37.592020), (55.610493, 37.493170), (55.639903, 37.460022), (55.711899, 37.385268), (55.610270, 37.493332),
    (55.638694, 37.459579), (55.667098, 37.427542), (55.714460, 37.386541), (55.753475, 37.370334), (55.790803, 37.371478),
    (55.832914, 37.393789), (55.880757, 37.445849), (55.907951, 37.545137), (55.880829, 37.442726),
]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    s = F.least(s, F.lit(1.0))
    return 2 * RADIUS_KM * F.atan2(F.sqrt(s), F.sqrt(1 - s))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction from the first point to the second, in degrees from north, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def _edges(ring: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(x1, y1, x2, y2) with x the longitude; the ring is closed."""
    points = [(lon, lat) for lat, lon in ring]
    if points[0] != points[-1]:
        points.append(points[0])
    return [(*p, *q) for p, q in zip(points[:-1], points[1:]) if p != q]


def _edge_array(ring: list[tuple[float, float]]) -> Column:
    """The edges as a constant array: x1, y1, x2, y2, dx, dy and the squared length."""
    whole = [(x1, y1, x2, y2, x2 - x1, y2 - y1, (x2 - x1) ** 2 + (y2 - y1) ** 2) for x1, y1, x2, y2 in _edges(ring)]
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2", "dx", "dy", "l2"), e)]) for e in whole])


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]] = RING) -> Column:
    """Even-odd rule over the edges; a ring that crosses itself keeps its holes. A null coordinate is outside."""

    def crosses(e: Column) -> Column:
        return ((e["y1"] > lat) != (e["y2"] > lat)) & F.coalesce(lon < e["x1"] + (lat - e["y1"]) / F.nullif(e["dy"], F.lit(0.0)) * e["dx"], F.lit(False))

    lats, lons = zip(*ring)
    box = F.coalesce(lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons)), F.lit(False))
    return F.when(box, F.size(F.filter(_edge_array(ring), crosses)) % 2 == 1).otherwise(False)


def polygon_distance(lat: Column, lon: Column, ring: list[tuple[float, float]] = RING) -> Column:
    """km from a point to the nearest point (in degrees) of the ring; 0 inside. What is used more than once is bound once."""

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]

    def nearest(e: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - e["x1"]) * e["dx"] + (lat - e["y1"]) * e["dy"]) / e["l2"]))
        point = lambda t: F.struct((e["x1"] + t * e["dx"]).alias("x"), (e["y1"] + t * e["dy"]).alias("y"))
        away = lambda p: F.struct(((lon - p["x"]) * (lon - p["x"]) + (lat - p["y"]) * (lat - p["y"])).alias("d2"), p["x"].alias("x"), p["y"].alias("y"))
        return once(once(t, point), away)

    near = F.array_min(F.transform(_edge_array(ring), nearest))
    return F.when(in_polygon(lat, lon, ring), F.lit(0.0)).otherwise(once(near, lambda n: haversine(lat, lon, n["y"], n["x"])))


# ---- hexagons: pointy-top cells on an equirectangular plane around a reference latitude

LAT0 = 55.7
KM_LAT = math.pi * RADIUS_KM / 180
KM_LON = KM_LAT * math.cos(math.radians(LAT0))


def edge_km(resolution: int) -> float:
    """Edge of a cell: 8.5 km at resolution 5, smaller by the square root of 7 with each step."""
    return 8.5 / 7 ** ((resolution - 5) / 2)


def hex_cell(lat: Column, lon: Column, resolution: int) -> Column:
    """struct<q,r>: axial coordinates of the cell. Rounding is floor(x + 0.5), so that engines agree."""
    size = edge_km(resolution)
    x, y = lon * F.lit(KM_LON), lat * F.lit(KM_LAT)
    q = (x * F.lit(math.sqrt(3) / 3) - y / F.lit(3.0)) / F.lit(size)
    r = y * F.lit(2.0 / 3.0) / F.lit(size)
    s = -q - r
    near = lambda v: F.floor(v + F.lit(0.5)).cast("double")
    rq, rr, rs = near(q), near(r), near(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    first = (dq > dr) & (dq > ds)
    return F.struct(F.when(first, -rr - rs).otherwise(rq).cast("long").alias("q"), F.when(~first & (dr > ds), -rq - rs).otherwise(rr).cast("long").alias("r"))


def hex_id(cell: Column, resolution: int) -> Column:
    return F.concat_ws("_", F.lit(str(resolution)), cell["q"].cast("string"), cell["r"].cast("string"))


#: Steps to the six neighbours.
NEIGHBOURS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]


def hex_corners(q: Column, r: Column, resolution: int) -> Column:
    """array<array<double>>: lon, lat of the corners, closed."""
    size = edge_km(resolution)
    cx = F.lit(size * math.sqrt(3)) * (q + r / F.lit(2.0))
    cy = F.lit(size * 1.5) * r
    at = [math.radians(60 * k - 30) for k in (0, 1, 2, 3, 4, 5, 0)]
    return F.array(*[F.array((cx + F.lit(size * math.cos(a))) / F.lit(KM_LON), (cy + F.lit(size * math.sin(a))) / F.lit(KM_LAT)) for a in at])
