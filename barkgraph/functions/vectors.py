"""Dense vectors (array<double>) as Column expressions; all sums run left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def normalized(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / F.when(n > 0, n))).otherwise(a)


def running_centroid(old: Column, n: Column, new: Column) -> Column:
    """Centroid of n + 1 vectors from that of n and a new one, of unit length."""
    return normalized(F.zip_with(old, new, lambda x, y: (x * n + y) / (n + 1)))


def ema(old: Column, new: Column, alpha: float = 0.30) -> Column:
    return normalized(F.zip_with(old, new, lambda x, y: x * (1 - alpha) + y * alpha))
