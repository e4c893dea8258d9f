"""Column functions on arrays of numbers, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is null or has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column, tiny: float = 1e-9) -> Column:
    """Divided by the norm plus `tiny`."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + F.lit(tiny)))


def prefix(a: Column, m: int) -> Column:
    """The first m components; of a truncated SVD that is the embedding of rank m."""
    return F.slice(a, 1, m)
