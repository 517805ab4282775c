"""Geodesy on a sphere, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088
METRO_KM = 161.0
DISAGREEMENT_KM = 2000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p, q = F.radians(_c(lat1)), F.radians(_c(lat2))
    up, side = F.sin((q - p) / 2), F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2)
    root = F.sqrt(up * up + F.cos(p) * F.cos(q) * side * side)
    return 2 * RADIUS_KM * F.asin(F.when(root > 1, 1.0).otherwise(root))  # least() would turn an unknown distance into 1


def wrap_longitude(lon, reference) -> Column:
    """The longitude within 180 degrees of the reference; a difference of exactly 180 either way is left as it is."""
    off = _c(lon) - _c(reference)
    return F.when(F.abs(off) <= 180, _c(lon)).otherwise(_c(lon) - 360 * F.ceil((off - 180) / 360))


def destination(lat, lon, km, bearing) -> Column:
    """struct(lat, lon) reached from a point over a distance on an initial bearing in degrees."""
    p, d, b = F.radians(_c(lat)), _c(km) / RADIUS_KM, F.radians(_c(bearing))
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.struct(F.degrees(q).alias("lat"), (_c(lon) + F.degrees(turn)).alias("lon"))


def geodesic_circle(lat, lon, km, segments: int = 72) -> Column:
    """Closed ring of segments + 1 points around a centre."""
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: destination(lat, lon, km, i * 360.0 / segments))


def great_circle(lat1, lon1, lat2, lon2, segments: int = 64) -> Column:
    """segments + 1 points along the shorter arc; two points if the ends coincide.

    Spark evaluates what a lambda holds anew for every element, and a name used twice twice.  So whatever is the same for the
    whole arc is one struct in an array of one, and points are made in steps, each of which reads the last one's fields.
    """
    p1, l1, p2, l2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    d = haversine_km(lat1, lon1, lat2, lon2) / RADIUS_KM
    xyz = lambda n, p, l: [(F.cos(p) * F.cos(l)).alias(f"x{n}"), (F.cos(p) * F.sin(l)).alias(f"y{n}"), F.sin(p).alias(f"z{n}")]  # noqa: E731, E741
    ends = F.array(F.struct(_c(lat1).alias("lat"), _c(lon1).alias("lon")), F.struct(_c(lat2).alias("lat"), _c(lon2).alias("lon")))

    def points(arc):
        share = lambda f: F.sin(f * arc["d"]) / arc["sin"]
        at = F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: F.struct(share(1 - i / segments).alias("u"), share(i / segments).alias("v")))
        at = F.transform(at, lambda w: F.struct(*((w["u"] * arc[f"{c}1"] + w["v"] * arc[f"{c}2"]).alias(c) for c in "xyz")))
        return F.transform(at, lambda r: F.struct(F.degrees(F.atan2(r["z"], F.sqrt(r["x"] * r["x"] + r["y"] * r["y"]))).alias("lat"), F.degrees(F.atan2(r["y"], r["x"])).alias("lon")))

    whole = F.transform(F.array(d), lambda d: F.struct(d.alias("d"), F.sin(d).alias("sin"), *xyz(1, p1, l1), *xyz(2, p2, l2)))
    return F.get(F.transform(whole, lambda arc: F.when(arc["d"] < 1e-12, ends).otherwise(points(arc))), F.lit(0))


def within_box(lat, lon, box: str = "") -> Column:
    """Inclusive test against columns min_lat, max_lat, min_lon and max_lon."""
    at = lambda n: F.col(f"{box}{n}")
    return _c(lat).between(at("min_lat"), at("max_lat")) & _c(lon).between(at("min_lon"), at("max_lon"))


def coordinate_faults(lat, lon) -> Column:
    """array<string>: what is wrong with a centroid; nothing if both are null or both are fine."""
    out = []
    for name, x, most in (("latitude", _c(lat), 90.0), ("longitude", _c(lon), 180.0)):
        odd = F.isnan(x) | (F.abs(x) == math.inf)
        out.append(F.when(odd, f"{name} not finite").when(F.abs(x) > most, f"{name} out of range"))
    return F.array_compact(F.array(*out))
