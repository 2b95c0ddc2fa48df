"""Column expressions of points, angles and vectors."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(*parts: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def norm1(*parts: Column) -> Column:
    return sum((F.abs(p) for p in parts[1:]), F.abs(parts[0]))


def norm_inf(*parts: Column) -> Column:
    return F.greatest(*[F.abs(p) for p in parts])


def dot(a, b) -> Column:
    pairs = [x * y for x, y in zip(a, b)]
    return sum(pairs[1:], pairs[0])


def cross(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def distance(a, b) -> Column:
    return norm(*[x - y for x, y in zip(a, b)])


def yaw(x: Column, y: Column) -> Column:
    """Angle in the plane from 0 to two pi."""
    return F.atan2(y, x) + F.lit(pi)


def pitch(x: Column, y: Column, z: Column) -> Column:
    """Angle to the vertical axis; null at the origin, where it is undefined."""
    # least and greatest skip nulls, so the origin is kept out before.
    n = norm(x, y, z)
    return F.when(n > 0, F.acos(F.least(F.greatest(z / F.nullif(n, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))))


def logistic(x: Column, x0: float, scale: float, k: float) -> Column:
    return F.lit(scale) / (F.lit(1.0) + F.exp(F.lit(-float(k)) * (x - F.lit(x0))))


def clamp(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def lcg_rank(seed: Column, n: Column) -> Column:
    """A reproducible pseudo-random number in [0, n): integer arithmetic that any SQL engine repeats."""
    # Only the seed's lowest 31 bits count: without the rest the product stays within 64 bits.
    return ((F.pmod(seed, F.lit(2147483648)) * 1103515245 + 12345) % 2147483648) % n
