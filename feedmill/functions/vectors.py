"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 for vectors of different size, NULL for a zero vector [V2]."""
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norm(a) * norm(b)))


def literal_vector(values: Sequence[float]) -> Column:
    """A constant ``array<double>``."""
    return F.array(*[F.lit(float(v)) for v in values])


def vector_text(a: Column) -> Column:
    """``[v1,v2,...]`` [V5]."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
