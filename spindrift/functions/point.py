"""Cartesian and geographic points of the query language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import spatial as _spatial
from spindrift.functions._base import col

_FIELDS = ("x", "y", "z", "latitude", "longitude", "height")


def make(**fields) -> Column:
    """A point from ``x``/``y``/``z`` or ``latitude``/``longitude``/``height``."""
    geographic = "latitude" in fields
    three = "z" in fields or "height" in fields
    srid = (4979 if three else 4326) if geographic else (9157 if three else 7203)
    crs = {4326: "wgs-84", 4979: "wgs-84-3d", 7203: "cartesian", 9157: "cartesian-3d"}[srid]
    return F.struct(*(col(fields[n]).cast("double").alias(n) if n in fields else F.lit(None).cast("double").alias(n) for n in _FIELDS), F.lit(srid).alias("srid"), F.lit(crs).alias("crs"))


def x(p) -> Column:
    return col(p)["x"]


def y(p) -> Column:
    return col(p)["y"]


def z(p) -> Column:
    return col(p)["z"]


def latitude(p) -> Column:
    return col(p)["latitude"]


def longitude(p) -> Column:
    return col(p)["longitude"]


def height(p) -> Column:
    return col(p)["height"]


def srid(p) -> Column:
    return col(p)["srid"]


def crs(p) -> Column:
    return col(p)["crs"]


def distance(p, q) -> Column:
    """Metres between geographic points, plain distance between others; null for
    a pair of different kinds."""
    a, b = col(p), col(q)
    square = lambda f: F.pow(F.coalesce(a[f], F.lit(0.0)) - F.coalesce(b[f], F.lit(0.0)), 2)
    return F.when(a["srid"] == b["srid"], F.when(a["latitude"].isNotNull(), _spatial.distance(p, q)).otherwise(F.sqrt(square("x") + square("y") + square("z"))))


def within_distance(p, q, limit) -> Column:
    return distance(p, q) <= limit


def within_b_box(p, low, high) -> Column:
    a, b, c = col(p), col(low), col(high)
    inside = lambda u, v: a[u].between(b[u], c[u]) & a[v].between(b[v], c[v])
    return F.when(a["latitude"].isNotNull(), inside("latitude", "longitude")).otherwise(inside("x", "y"))


def contains(polygon, p) -> Column:
    return _spatial.point_in_polygon(p, polygon)


def intersects(p, polygon) -> Column:
    return _spatial.point_in_polygon(p, polygon)


def polygon(*points) -> Column:
    return F.array(*map(col, points))


def line_string(*points) -> Column:
    return F.array(*map(col, points))
