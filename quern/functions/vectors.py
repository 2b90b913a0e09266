"""Distances of numeric lists, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double"))


def _paired(a, b, f) -> Column:
    x, y = _c(a), _c(b)
    return _sum(F.zip_with(x, y, f))


def inner_product(a, b) -> Column:
    """Sum of products; lists of unlike length give null."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), _paired(a, b, lambda p, q: p.cast("double") * q.cast("double")))


def negative_inner_product(a, b) -> Column:
    return -inner_product(a, b)


def distance(a, b) -> Column:
    """Euclidean."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.sqrt(_paired(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2)))))


def cosine_similarity(a, b) -> Column:
    return inner_product(a, b) / F.sqrt(inner_product(a, a) * inner_product(b, b))


def cosine_distance(a, b) -> Column:
    return 1 - cosine_similarity(a, b)


def cross_product(a, b) -> Column:
    """Of two lists of three."""
    x, y = _c(a), _c(b)
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])
