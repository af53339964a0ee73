"""Vector arithmetic over array columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a) + 1e-12
    return F.transform(_d(a), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-12)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def contrastive(d: Column, same: Column, margin: float = 1.0) -> Column:
    """Loss of a pair at distance ``d``: its square if of one class, else that of what the margin lacks."""
    short = F.greatest(F.lit(margin) - d, F.lit(0.0))
    return F.when(same, d * d).otherwise(short * short)


def triplet(near: Column, far: Column, margin: float = 0.3) -> Column:
    return F.greatest(near - far + margin, F.lit(0.0))
