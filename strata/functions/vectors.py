"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision; nulls if the sizes differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors that are null, empty, zero or of different sizes."""
    scale = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0)
    return F.coalesce(F.when(fits, dot(a, b) / scale), F.lit(0.0))


def once(value: Column, f) -> Column:
    """f of a value that is made once: inside a lambda an expression would be evaluated again for each element."""
    return F.transform(F.array(value), f)[0]


def normalize(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return once(a, lambda v: once(norm(v), lambda length: F.when(length > 0, F.transform(v, lambda x: (x / length).cast("float"))).otherwise(v)))
