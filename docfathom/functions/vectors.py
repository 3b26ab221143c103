"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Plain dot product; 0 if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def finite(v: Column, dimensions: int | None = None) -> Column:
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return ok & (F.size(v) == dimensions) if dimensions is not None else ok


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x.cast("double") / norm))


def nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)
