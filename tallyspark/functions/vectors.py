"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, digits: int | None = 6) -> Column:
    """Cosine in double precision, rounded; 0 for vectors of different or no length and for zero vectors."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), _dot(a, b) / norm).otherwise(F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def unit(v: Column) -> Column:
    """The vector at length 1 as doubles; zero vectors stay."""
    n = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return _dot(a, b)


def to_json(v: Column) -> Column:
    return F.to_json(v)


def from_json(text: Column) -> Column:
    """A list of numbers written as JSON; null if it isn't one."""
    return F.from_json(text, "array<float>")
