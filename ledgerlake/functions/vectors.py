"""Distances between array columns, as column expressions (double precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: cosine distance is 1 where the product of the norms is smaller than this.
SMALLEST_NORM = 1.1920929e-7


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(kind: str, a: Column, b: Column) -> Column:
    """``l2``, ``cosine`` or ``inner_product`` (negated, so that smaller is nearer)."""
    if kind == "l2":
        return F.sqrt(squared_l2(a, b))
    if kind == "inner_product":
        return -dot(a, b)
    if kind != "cosine":
        raise ValueError(f"unknown distance {kind!r}")
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms < SMALLEST_NORM, 1.0).otherwise(1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / norms)))


def is_valid(v: Column, dimensions: int) -> Column:
    """Right number of components, none null, NaN or infinite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimensions) & ~bad, F.lit(False))
