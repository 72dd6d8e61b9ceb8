"""Points on the Earth, in degrees and metres (sphere of 6,371 km)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items

RADIUS = 6_371_000.0


def point(latitude, longitude) -> Column:
    return F.struct(col(latitude).cast("double").alias("latitude"), col(longitude).cast("double").alias("longitude"))


def haversine_distance(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distance(p, q) -> Column:
    a, b = col(p), col(q)
    return haversine_distance(a["latitude"], a["longitude"], b["latitude"], b["longitude"])


def vincenty_distance(lat1, lon1, lat2, lon2) -> Column:
    """On the sphere, by the formula that is stable at all distances."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    up = F.sqrt(F.pow(F.cos(c) * F.sin(d - b), 2) + F.pow(F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b), 2))
    return RADIUS * F.atan2(up, F.sin(a) * F.sin(c) + F.cos(a) * F.cos(c) * F.cos(d - b))


def bearing(p, q) -> Column:
    """Degrees from north, 0 to 360."""
    a, b = col(p), col(q)
    x, y, dl = F.radians(a["latitude"]), F.radians(b["latitude"]), F.radians(b["longitude"] - a["longitude"])
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(y), F.cos(x) * F.sin(y) - F.sin(x) * F.cos(y) * F.cos(dl))) + 360, F.lit(360.0))


def destination(p, bearing_degrees, metres) -> Column:
    a, t, d = col(p), F.radians(col(bearing_degrees)), col(metres) / RADIUS
    x, l1 = F.radians(a["latitude"]), F.radians(a["longitude"])
    y = F.asin(F.sin(x) * F.cos(d) + F.cos(x) * F.sin(d) * F.cos(t))
    return point(F.degrees(y), F.degrees(l1 + F.atan2(F.sin(t) * F.sin(d) * F.cos(x), F.cos(d) - F.sin(x) * F.sin(y))))


def midpoint(p, q) -> Column:
    a, b = col(p), col(q)
    x, y, dl, l1 = F.radians(a["latitude"]), F.radians(b["latitude"]), F.radians(b["longitude"] - a["longitude"]), F.radians(a["longitude"])
    bx, by = F.cos(y) * F.cos(dl), F.cos(y) * F.sin(dl)
    return point(F.degrees(F.atan2(F.sin(x) + F.sin(y), F.sqrt(F.pow(F.cos(x) + bx, 2) + F.pow(by, 2)))), F.degrees(l1 + F.atan2(by, F.cos(x) + bx)))


def bounding_box(points) -> Column:
    a = items(points)
    lat, lon = F.transform(a, lambda p: p["latitude"]), F.transform(a, lambda p: p["longitude"])
    return F.struct(F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"))


def within(p, box) -> Column:
    a, b = col(p), col(box)
    return a["latitude"].between(b["min_lat"], b["max_lat"]) & a["longitude"].between(b["min_lon"], b["max_lon"])


def intersects(a, b) -> Column:
    x, y = col(a), col(b)
    return (x["min_lat"] <= y["max_lat"]) & (x["max_lat"] >= y["min_lat"]) & (x["min_lon"] <= y["max_lon"]) & (x["max_lon"] >= y["min_lon"])


def contains(a, b) -> Column:
    x, y = col(a), col(b)
    return (x["min_lat"] <= y["min_lat"]) & (x["max_lat"] >= y["max_lat"]) & (x["min_lon"] <= y["min_lon"]) & (x["max_lon"] >= y["max_lon"])


def within_distance(p, points, metres: float) -> Column:
    return F.filter(items(points), lambda q: distance(p, q) <= metres)


def k_nearest(p, points, k: int) -> Column:
    d = F.array_sort(F.transform(items(points), lambda q: F.struct(distance(p, q).alias("d"), q.alias("p"))))
    return F.transform(F.slice(d, 1, k), lambda s: s["p"])


def nearest(p, points) -> Column:
    return F.try_element_at(k_nearest(p, points, 1), F.lit(1))


def centroid(points) -> Column:
    a = items(points)
    mean = lambda f: F.aggregate(a, F.lit(0.0), lambda s, p: s + p[f]) / F.size(a)
    return point(mean("latitude"), mean("longitude"))


def area(points) -> Column:
    """Square metres inside a ring, on the sphere."""
    a = items(points)
    after = F.concat(F.slice(a, F.lit(2), F.size(a)), F.slice(a, 1, 1))
    parts = F.zip_with(a, after, lambda p, q: F.radians(q["longitude"] - p["longitude"]) * (2 + F.sin(F.radians(p["latitude"])) + F.sin(F.radians(q["latitude"]))))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) * RADIUS * RADIUS / 2


def point_in_polygon(p, points) -> Column:
    """Ray casting: an odd number of crossings is inside."""
    a, q = items(points), col(p)
    after = F.concat(F.slice(a, F.lit(2), F.size(a)), F.slice(a, 1, 1))
    crosses = F.zip_with(a, after, lambda s, e: F.when(
        ((s["latitude"] > q["latitude"]) != (e["latitude"] > q["latitude"]))
        & (q["longitude"] < (e["longitude"] - s["longitude"]) * F.try_divide(q["latitude"] - s["latitude"], e["latitude"] - s["latitude"]) + s["longitude"]), 1).otherwise(0))
    return F.aggregate(crosses, F.lit(0), lambda s, x: s + x) % 2 == 1


def to_geo_json(p) -> Column:
    a = col(p)
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(a["longitude"], a["latitude"]).alias("coordinates")))


def from_geo_json(s) -> Column:
    j = F.from_json(col(s), "type string, coordinates array<double>")
    return point(F.get(j["coordinates"], F.lit(1)), F.get(j["coordinates"], F.lit(0)))


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def encode_geohash(p, precision: int = 12) -> Column:
    """Interleaved halvings of longitude and latitude, five bits a letter."""
    a, n = col(p), 5 * precision
    lon_bits, lat_bits = (n + 1) // 2, n // 2
    grid = lambda v, low, width, bits: F.least(F.floor((v - low) / width * 2**bits), F.lit(2**bits - 1)).cast("long")
    lon = F.lpad(F.bin(grid(a["longitude"], -180, 360, lon_bits)), lon_bits, "0")
    lat = F.lpad(F.bin(grid(a["latitude"], -90, 180, lat_bits)), lat_bits, "0")
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 2 == 0, F.substr(lon, (i / 2).cast("int") + 1, F.lit(1))).otherwise(F.substr(lat, ((i - 1) / 2).cast("int") + 1, F.lit(1)))), "")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(precision - 1)), lambda i: F.substr(F.lit(_BASE32), F.conv(F.substr(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")


def decode_geohash(s) -> Column:
    """The middle of a geohash's cell."""
    bits = F.array_join(F.transform(F.split(col(s), ""), lambda c: F.lpad(F.bin(F.instr(F.lit(_BASE32), c) - 1), 5, "0")), "")
    each = F.split(bits, "")
    half = lambda odd, low, width: F.aggregate(
        F.filter(each, lambda _, i: i % 2 == odd), F.struct(F.lit(low).alias("low"), F.lit(width).alias("width")),
        lambda st, b: F.struct((st["low"] + F.when(b == "1", st["width"] / 2).otherwise(0.0)).alias("low"), (st["width"] / 2).alias("width")), lambda st: st["low"] + st["width"] / 2)
    return point(half(1, -90.0, 180.0), half(0, -180.0, 360.0))
