"""Vector arithmetic as column expressions on array columns; all in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null if either vector is null or holds a null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def mean_vector(v: Column, dim: int) -> Column:
    """Aggregate: the mean vector. One average per dimension, so it is partially aggregated before the shuffle."""
    return F.array(*[F.avg(v[i]) for i in range(dim)])


def sum_vector(v: Column, dim: int) -> Column:
    return F.array(*[F.sum(v[i]) for i in range(dim)])


def unit(v: Column) -> Column:
    """v scaled to length one; null for a zero vector."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x / size))


def is_valid(v: Column, dim: int) -> Column:
    """dim numbers, none null, NaN or infinite, and not all zero."""
    high = F.array_max(F.transform(v, lambda x: F.abs(F.coalesce(x.cast("double"), F.lit(float("inf"))))))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & ~F.isnan(high) & (high < float("inf")) & (high > 0), F.lit(False))
