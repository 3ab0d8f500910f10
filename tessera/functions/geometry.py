"""Hyperbolic and plane geometry on array columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

EDGE = 0.999999


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def scale(a: Column, k: Column) -> Column:
    # k, which is often made from a's norm, is worked out once and not for each element
    return let(k, lambda k: F.transform(a, lambda x: x.cast("double") * k))


def clip(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(F.least(x, F.lit(EDGE)), F.lit(-EDGE)))


def exp0(v: Column) -> Column:
    """From the tangent space at the origin into the ball."""
    n = norm(v)
    return clip(scale(v, F.when(n > 0, F.tanh(n / 2) / n).otherwise(F.lit(0.0))))


def log0(x: Column) -> Column:
    n = norm(x)
    return scale(x, F.when(n > 0, 2 * F.atanh(F.least(n, F.lit(EDGE))) / n).otherwise(F.lit(0.0)))


def distance(a: Column, b: Column) -> Column:
    """Distance of two points of the Poincaré ball."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    room = F.greatest((1 - dot(a, a)) * (1 - dot(b, b)), F.lit(1e-12))
    return F.acosh(F.greatest(F.lit(1.0), 1 + 2 * gap / room))


def similarity(d: Column) -> Column:
    return 1 / (1 + d)


def mobius_add(u: Column, v: Column) -> Column:
    uu, vv, uv = dot(u, u), dot(v, v), 2 * dot(u, v)
    below = 1 + uv + uu * vv
    return F.zip_with(u, v, lambda x, y: ((1 + uv + vv) * x + (1 - uu) * y) / below)


def to_klein(x: Column) -> Column:
    return scale(x, 2 / (1 + dot(x, x)))


def from_klein(k: Column) -> Column:
    return scale(k, 1 / (1 + F.sqrt(F.greatest(1 - dot(k, k), F.lit(0.0)))))


def decay(age_s: Column, rate: float = 0.0001) -> Column:
    return F.exp(-rate * age_s)


def time_distance(d: Column, gap_s: Column, weight: float = 0.1) -> Column:
    return d + weight * F.abs(gap_s)


def plane_similarity(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Nearness on an equirectangular map: 1 / (1 + degrees / 45)."""
    dx = (lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2))
    return 1 / (1 + F.hypot(dx, lat1 - lat2) / 45)
